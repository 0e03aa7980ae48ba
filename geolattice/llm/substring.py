"""Removal of word passages that repeat anywhere in a corpus, by prefix-partitioned suffix trees.

A window is the first ``window`` words of a suffix (one starts at each word). Two
windows are equal if their suffixes meet in an internal node of the corpus' suffix
tree that is at least ``window`` words deep. The tree is built in parts:

* *Grouping.* A window's anchor is the place in it where the words' ``prefix``-gram has
  the smallest hash, the leftmost one; equal windows have equal anchors, and
  neighbouring windows mostly share theirs, so that they travel as one stretch of
  words. Windows are grouped by the words that all windows of a range of anchor
  offsets hold: at first all offsets, a prefix of 8 words from the anchor on.
* *Variable length.* Where the stretches of a group pass GROUP_WORDS words, the range
  of offsets is halved, which lengthens the prefix to 22, 29, 32, 34 and 35 words.
  At 35 all suffixes of a group are equal, and only their number counts. Groups
  whose prefix occurs once are dropped. Two bit sets of fixed size, put together
  from hash-partitioned slices, say which prefixes come twice and which are to be
  lengthened; a full one sends or splits more, never less.
* *Trees.* The suffixes of a group are sorted by their words (by hashes of the first
  half, then of all words, which orders the branches), the longest common prefix of
  neighbours is counted word by word, and runs at least ``window`` deep are the
  tree's deep internal nodes. Neighbouring windows found in them join to maximal
  repeats.
* Equal stretches of one portion of rows are settled there; one witness stands for
  them, so a passage that a third of the corpus holds sends a few stretches from
  each portion, not one from each copy.

Words are compared by 64-bit hashes, a window by those of its 35 words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize, others, schema_of, unused
from .wordhash import U, Words, bucket_rows, chunks, mix, slices

WINDOW, PREFIX = 35, 8
GROUP_WORDS = 1 << 16
BUCKET_BYTES, PORTION_WORDS = 8 << 20, 1 << 20
LEAST_FILTER, MOST_FILTER = 20, 28
TWICE, LARGE = 0, 1
_ROW, _SPANS = "_geolattice_row", "_geolattice_spans"


def _spread(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges first..first+length, and the range of each."""
    which = np.repeat(np.arange(len(first)), length)
    before = np.cumsum(length) - length
    return np.arange(len(which)) - before[which] + first[which], which


def _portions(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """(index of the first text, its and the next texts' words): about PORTION_WORDS, or one text."""
    at, held = 0, []
    for here, words in chunks(column, False):
        if held and sum(len(w.hashes) for w in held) + len(words.hashes) > PORTION_WORDS:
            yield at, _joined(held)
            at, held = here, []
        held.append(words)
    if held:
        yield at, _joined(held)


def _joined(parts: list[Words]) -> Words:
    base = np.cumsum([0, *(len(w.hashes) for w in parts)])
    first = np.concatenate([w.first[:-1] + b for w, b in zip(parts, base)] + [base[-1:]])
    none = np.zeros(0, np.int64)
    return Words(np.zeros(0, np.uint8), none, none, none, first, np.concatenate([w.hashes for w in parts]))


@dataclass
class Stretches:
    """Runs of neighbouring windows with one anchor: first window, number of windows, anchor."""

    words: Words
    window: int
    prefix: int

    def __post_init__(self) -> None:
        n, none = len(self.words.hashes), np.zeros(0, np.int64)
        self.first = self.count = self.anchor = none
        if n < self.window:
            return
        low = self.words.grams(self.prefix)[: n - self.prefix + 1]
        at = np.arange(len(low))
        width, span = self.window - self.prefix + 1, 1
        while span < width:  # smallest of each ``span`` neighbours, by doubling
            step = min(span, width - span)
            right = low[step:] < low[:-step]
            at, low = np.where(right, at[step:], at[:-step]), np.where(right, low[step:], low[:-step])
            span += step
        ok = self.words.starts_of(self.window)[: len(at)]
        same = np.zeros(len(at), bool)
        same[1:] = ok[1:] & ok[:-1] & (at[1:] == at[:-1])
        self.first = np.flatnonzero(ok & ~same)
        self.count = np.flatnonzero(ok & ~np.r_[same[1:], False]) - self.first + 1
        self.anchor = at[self.first]

    def any(self, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the stretches have windows whose anchor is ``low`` to ``high`` words after their start."""
        a, s = self.anchor[which], self.first[which]
        return np.maximum(s, a - high) <= np.minimum(s + self.count[which] - 1, a - low)

    def prints(self) -> np.ndarray:
        return self.words.spans(self.first, self.count + self.window - 1)

    def pieces(self, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the stretches ``which``, the windows whose anchor is ``low`` to ``high`` words after their start.

        Those stretches that have any, their ranges, first window, number, and the group's key.
        """
        some = self.any(which, low, high)
        which, low, high = which[some], low[some], high[some]
        a, s = self.anchor[which], self.first[which]
        start, stop = np.maximum(s, a - high), np.minimum(s + self.count[which] - 1, a - low)
        key = mix(self.words.spans(a - low, self.window - (high - low)) + (low * 4096 + high).astype(np.uint64))
        return which, low, high, start, stop - start + 1, key

    def whole(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """All windows of the stretches, as ``pieces``."""
        return self.pieces(which, np.zeros(len(which), np.int64), np.full(len(which), self.window - self.prefix))


def _halves(which: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    middle = (low + high) // 2
    return np.r_[which, which], np.r_[low, middle + 1], np.r_[middle, high]


@dataclass
class Sizes:
    """Numbers of buckets and bits, from the size of the texts."""

    count_bits: int
    ship_bits: int
    filter_bits: int

    @classmethod
    def of(cls, docs: DataFrame, filter_bits: int | None) -> Sizes:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        least = math.ceil(math.log2(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
        # About one stretch in 80 bytes of text; it is counted in 13 bytes, and sent in about 400.
        log = lambda x: math.ceil(math.log2(max(1, x)))
        filter_bits = filter_bits or min(MOST_FILTER, max(LEAST_FILTER, log(size / 10)))
        count_bits = min(filter_bits - 6, max(least, log(size / 80 * 13 / BUCKET_BYTES)))
        return cls(max(0, count_bits), min(26, max(least, log(size * 5 / BUCKET_BYTES))), filter_bits)


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> U(63 - bits) >> U(1)).astype(np.int64)


def _places(key: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U((1 << each) - 1)
    return (key & mask).astype(np.int64), (mix(key) & mask).astype(np.int64)


@dataclass
class Filter:
    """Bits of the keys that occur twice, and of those whose group is to be divided. What is in it is reported; a little else may be."""

    sizes: Sizes
    bits: np.ndarray

    def has(self, key: np.ndarray, kind: int) -> np.ndarray:
        each = self.sizes.filter_bits - self.sizes.count_bits
        base = _bucket(key, self.sizes.count_bits) << each
        out = np.ones(len(key), bool)
        for x in _places(key, each):
            x = x + base
            out &= (self.bits[kind, x >> 3] >> (7 - (x & 7)) & 1) > 0
        return out


def _count(docs: DataFrame, window: int, prefix: int, sizes: Sizes, group_words: int, above: object | None) -> tuple[np.ndarray, int]:
    """The bits of a Filter, and the number of groups to be divided: of whole stretches, or, with the filter ``above`` (broadcast), of all parts of those that it says are to be divided."""
    bits, each = sizes.count_bits, sizes.filter_bits - sizes.count_bits

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for _, words in _portions(batch.column(0)):
                runs = Stretches(words, window, prefix)
                _, alone, copies = np.unique(runs.prints(), return_index=True, return_counts=True)
                which, low, high, _, n, key = runs.whole(alone)
                if above is not None:
                    hot = above.value.has(key, TWICE) & above.value.has(key, LARGE)
                    which, low, high, copies = which[hot], low[hot], high[hot], copies[hot]
                    found = [(key[:0], n[:0], copies[:0])]
                    while len(which):
                        copies = np.r_[copies, copies]
                        which, low, high = _halves(which, low, high)
                        some = runs.any(which, low, high)
                        copies = copies[some]
                        which, low, high, _, n, key = runs.pieces(which[some], low[some], high[some])
                        found.append((key, n, copies))
                        wide = low < high
                        which, low, high, copies = which[wide], low[wide], high[wide], copies[wide]
                    key, n, copies = (np.concatenate(x) for x in zip(*found))
                if not len(key):
                    continue
                value, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
                size = np.bincount(inverse, n + window - 1, len(value))
                many = (count > 1) | (np.bincount(inverse, copies > 1, len(value)) > 0)
                rows = list(bucket_rows(_bucket(value, bits), value, many, np.minimum(size, 2**32 - 1).astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[1][i] for r in rows], pa.binary()) for i in range(3))], ["bucket", "value", "many", "size"])

    def decide(table: pa.Table) -> pa.Table:
        value, many, size = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("value", np.uint64), ("many", bool), ("size", np.uint32)))
        value, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
        twice = count > 1
        twice[inverse[many]] = True
        large = twice & (np.bincount(inverse, size, len(value)) > group_words)
        out = []
        for chosen in (twice, large):
            slice_ = np.zeros(1 << each, bool)
            for x in _places(value[chosen], each):
                slice_[x] = True
            out.append(np.packbits(slice_).tobytes() if chosen.any() else b"")
        bucket = pa.array([table["bucket"][0].as_py()], pa.int32())
        return pa.table({"bucket": bucket, "twice": pa.array(out[:1], pa.binary()), "large": pa.array(out[1:], pa.binary()), "n": pa.array([int(large.sum())], pa.int64())})

    rows = docs.select("text").mapInArrow(gather, "bucket int, value binary, many binary, size binary")
    out, n = np.zeros((2, 1 << bits, 1 << each >> 3), np.uint8), 0
    decided = rows.groupBy("bucket").applyInArrow(decide, "bucket int, twice binary, large binary, n long")
    for row in decided.where("length(twice) > 0").collect():  # 2 * 2**filter_bits bits in all
        for kind, c in enumerate(("twice", "large")):
            if row[c]:
                out[kind, row["bucket"]] = np.frombuffer(row[c], np.uint8)
        n += row["n"]
    return out.reshape(2, -1), n


def repeated_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, filter_bits: int | None = None, group_words: int = GROUP_WORDS) -> DataFrame:
    """(key, spans) of rows (key, text): first word and number of the windows that occur again elsewhere, as pairs of 32-bit integers. A key may have several rows."""
    context = docs.sparkSession.sparkContext
    sizes = Sizes.of(docs, filter_bits)
    bits, large = _count(docs, window, prefix, sizes, group_words, None)
    if large:  # the prefixes that lengthening gives are counted too
        above = context.broadcast(Filter(sizes, bits))
        bits |= _count(docs, window, prefix, sizes, group_words, above)[0]
    shared = context.broadcast(Filter(sizes, bits))  # 2 * 2**filter_bits bits

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in slices(batches):
            row = np.asarray(batch.column(0))
            for at, words in _portions(batch.column(1)):
                runs = Stretches(words, window, prefix)
                if not len(runs.first):
                    continue
                _, alone, inverse, copies = np.unique(runs.prints(), return_index=True, return_inverse=True, return_counts=True)
                doc = np.searchsorted(words.first, runs.first, "right") - 1
                owner, place = row[at + doc], runs.first - words.first[doc]
                local = (copies > 1)[inverse]
                settled = [(owner[local], place[local], runs.count[local])]
                which, low, high, start, n, key = runs.whole(alone)
                known = copies > 1
                sent = []
                while len(which):
                    some = seen.has(key, TWICE)
                    divide = some & seen.has(key, LARGE) & (low < high)
                    go = some & ~divide
                    sent.append(tuple(x[go] for x in (which, start, n, key, known, low == high)))
                    which, low, high, known = which[divide], low[divide], high[divide], known[divide]
                    known = np.r_[known, known]
                    which, low, high = _halves(which, low, high)
                    some = runs.any(which, low, high)
                    known = known[some]
                    which, low, high, start, n, key = runs.pieces(which[some], low[some], high[some])
                which, start, n, key, known, single = (np.concatenate(x) for x in zip(*sent))
                # Windows of the longest prefix: equal ones of this portion are settled, one goes on.
                one = np.flatnonzero(single)
                _, first, inverse, count = np.unique(key[one], return_index=True, return_inverse=True, return_counts=True)
                several = np.bincount(inverse, known[one], len(first)) + (count > 1) > 0
                again = one[several[inverse] & ~known[one]]
                settled.append((owner[which[again]], start[again] - words.first[doc[which[again]]], n[again]))
                known[one[first]] = several
                keep = np.ones(len(which), bool)
                keep[np.delete(one, first)] = False
                which, start, n, key, known, single = (x[keep] for x in (which, start, n, key, known, single))
                sent_ = (owner[which], start - words.first[doc[which]], start, n, key, known, single)
                yield _packed(words, sizes, window, sent_, [np.concatenate(x) for x in zip(*settled)])

    def tree(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        key, row, known, text = read("key", np.uint64), read("row", np.int64), read("known", np.uint8), read("words", np.uint64)
        place, n = (read(c, np.uint32).astype(np.int64) for c in ("place", "n"))
        done, single, known = known == 2, known >= 4, known & 1 > 0  # settled windows only pass
        found = [(row[done], place[done], n[done])]
        _, inverse, count = np.unique(key[single], return_inverse=True, return_counts=True)
        sure = np.bincount(inverse, known[single], len(count)) + (count > 1) > 0
        hit = np.flatnonzero(single)[sure[inverse]]
        hit = hit[~known[hit]]
        found.append((row[hit], place[hit], n[hit]))
        whole = np.flatnonzero(~done & ~single)
        length = n[whole] + window - 1
        index, which = _spread(np.cumsum(length) - length, n[whole])
        equal = _deep_nodes(text, index, key[whole][which], window) | known[whole][which]
        equal &= ~known[whole][which]  # those are settled where they were met
        before = np.cumsum(n[whole]) - n[whole]
        found.append(_runs(row[whole][which][equal], (place[whole][which] + np.arange(len(which)) - before[which])[equal]))
        row, place, n = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(row, kind="stable")
        row, pairs = row[order], np.stack([place[order].astype(np.uint32), n[order].astype(np.uint32)], 1)
        cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        spans = [pairs[a:b].tobytes() for a, b in zip(cuts, np.r_[cuts[1:], len(row)])]
        return pa.table({_ROW: pa.array(row[cuts], pa.int64()), "spans": pa.array(spans, pa.binary())})

    rows = docs.select(_ROW, "text").mapInArrow(ask, "bucket int, key binary, row binary, place binary, n binary, known binary, words binary")
    return rows.groupBy("bucket").applyInArrow(tree, f"{_ROW} long, spans binary")


def _deep_nodes(text: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Marks the suffixes, from ``start`` on in ``text``, below an internal node at least ``depth`` words deep of their group's tree."""
    out = np.zeros(len(start), bool)
    if len(start) < 2:
        return out
    words = Words(text[:0], start[:0], start[:0], start[:0], np.array([0, len(text)]), text)
    order = np.lexsort((words.spans(start, depth), words.spans(start, depth // 2), group))
    suffix, group = start[order], group[order]
    pair = np.flatnonzero(group[1:] == group[:-1])
    for at in range(depth):  # the longest common prefix of neighbours, as far as it matters
        pair = pair[text[suffix[pair] + at] == text[suffix[pair + 1] + at]]
    out[order[pair]] = out[order[pair + 1]] = True
    return out


def _packed(words: Words, sizes: Sizes, window: int, sent: tuple[np.ndarray, ...], settled: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket: stretches with their words (none for single windows), and windows that are settled."""
    row, place, start, n, key, known, single = sent
    kind = np.r_[known + 4 * single, np.full(len(settled[0]), 2)].astype(np.uint8)
    key = np.r_[key, mix(settled[0].view(np.uint64))]  # anywhere
    row, place, n = np.r_[row, settled[0]], np.r_[place, settled[1]].astype(np.uint32), np.r_[n, settled[2]].astype(np.uint32)
    size = np.r_[np.where(single, 0, n[: len(single)].astype(np.int64) + window - 1), np.zeros(len(settled[0]), np.int64)]
    start = np.r_[start, np.zeros(len(settled[0]), np.int64)]
    bucket = _bucket(key, sizes.ship_bits)
    order = np.argsort(bucket, kind="stable")
    bucket, key, row, place, n, kind, size, start = (x[order] for x in (bucket, key, row, place, n, kind, size, start))
    text = words.hashes[_spread(start, size)[0]]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends, upto = np.r_[cuts[1:], len(bucket)], np.r_[0, np.cumsum(size)]
    columns = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for x in (key, row, place, n, kind)]
    text = pa.array([text[upto[a] : upto[b]].tobytes() for a, b in zip(cuts, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), *columns, text], ["bucket", "key", "row", "place", "n", "known", "words"])


def _runs(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins neighbouring windows of a document: key, first window, number."""
    cuts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (places[1:] != places[:-1] + 1)]) if len(rows) else np.zeros(0, np.int64)
    return rows[cuts], places[cuts], np.diff(np.r_[cuts, len(rows)])


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, filter_bits: int | None = None, group_words: int = GROUP_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the words that no repeated window covers, joined by one space).

    Words are runs of other characters than ASCII white space. A window counts
    if its ``window`` words also start anywhere else, the same document included;
    a repeated row is another document. A null or empty text has no words and
    keeps the empty text; a document of fewer than ``window`` words keeps all.
    Other columns go through unchanged (those of the new names, in any case, are
    replaced), and ``doc_id`` may be null or repeated. A group whose stretches have
    more than ``group_words`` words gets a longer prefix; ``filter_bits`` is the
    logarithm of the bit sets' size, by default from the texts' size. Neither
    changes the result.
    """
    key, held = unused(docs, _ROW), unused(docs, _SPANS)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    spans = materialize(repeated_spans(keyed.select(F.col(key).alias(_ROW), "text"), window, prefix, filter_bits, group_words), "spans")
    spans = spans.groupBy(F.col(_ROW).alias(key)).agg(F.collect_list("spans").alias(held))
    joined = keyed.join(spans.hint("shuffle_hash"), key, "left").drop(key)
    names = others(docs, "n_words", "n_removed", "kept")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at_text, spans = batch.schema.get_field_index("text"), batch.column(batch.schema.get_field_index(held)).to_pylist()
            kept, n_words, n_removed = [], [], []
            for at, words in chunks(batch.column(at_text), False):
                total = len(words.hashes)
                cover = np.zeros(total + 1, np.int64)
                for d in range(words.docs):
                    for one in spans[at + d] or ():
                        pair = np.frombuffer(one, np.uint32).reshape(-1, 2).astype(np.int64)
                        a = words.first[d] + pair[:, 0]
                        np.add.at(cover, a, 1)
                        np.add.at(cover, a + pair[:, 1] + window - 1, -1)
                keep = np.cumsum(cover)[:-1] == 0
                count = np.r_[0, np.cumsum(keep)]
                count = count[words.first[1:]] - count[words.first[:-1]]
                n_words.append(np.diff(words.first))
                n_removed.append(n_words[-1] - count)
                n = len(words.data)
                inside = np.zeros(n + 2, np.int8)
                a, b = words.starts[keep], words.ends[keep]
                last = np.zeros(len(a), bool)
                last[np.cumsum(count)[count > 0] - 1] = True
                inside[a] += 1
                np.add.at(inside, b + ~last, np.int8(-1))
                chosen = np.cumsum(inside[:n], dtype=np.int8) > 0
                data = words.data.copy()
                data[b[~last]] = 32
                size = np.r_[0, np.cumsum(chosen)][words.offsets]
                data = data[chosen].tobytes()
                kept += [data[x:y].decode() for x, y in zip(size[:-1], size[1:])]
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            out |= {c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in (("n_words", n_words), ("n_removed", n_removed))}
            out["kept"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return joined.mapInArrow(cut, schema_of(docs, names, "n_words long, n_removed long, kept string"))
