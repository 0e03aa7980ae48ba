"""Similarity join of documents on word n-gram sets: a grouped prefix join.

1. Documents with equal sets collapse to one *set* (its 64-bit fingerprint).
2. Tokens are ordered rare first: all but the most frequent (a bounded list, so
   small enough to hand to every task) by hash, then the frequent ones by count.
   Any order is right; this one keeps common passages out of the prefixes.
3. Two sets that reach the threshold share a token among the first
   n - ceil(t * n) + 1 of each. Sets of equal prefix and size form one group;
   the groups' prefix tokens are dealt out by token, packed in binary rows.
4. Short lists of a token give group pairs that pass the size and position
   filters; a parity-bitmap bound on the overlap then drops most that fail.
5. Groups of a long list that may have a partner there by the position filter
   are chained; a large chained cluster is divided by the same bound, and each
   cluster compared block by block, as matrix products. Pairs of blocks are dealt
   out over all tasks, so that no task holds a whole cluster, and no pair of sets
   becomes a row.
6. Groups are expanded, and all remaining pairs verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Scratch
from ..operators.tiles import block_pairs, units
from .components import connected_components
from .forest import forest
from .session import bucket_bits, materialize
from .wordhash import U, Words, bucket_rows, chunks, mix, slices

SHINGLE, PERCENT = 5, 75
FREQUENT, MOST_FREQUENT = 1 << 16, 1 << 22
SHORT_LIST = 6
BLOCK_TOKENS, BLOCK_ROWS = 1 << 16, 512
LEAST_FILTER, MOST_FILTER = 16, 28
DENSE = 1 << 21


def _sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document."""
    grams, h, first = words.grams(k), words.hashes, words.first
    for d in range(words.docs):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            x = grams[a : b - k + 1].copy()
            x.sort()
            fresh = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=fresh[1:])
            yield x[fresh]
        elif b > a:
            yield mix(np.array([int((h[a:b] * U(0x100000001B3) ** np.arange(1, b - a + 1, dtype=np.uint64)).sum())], np.uint64) + U(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _print(x: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set."""
    total = (int(mix(x ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) * 0xD6E8FEB86659FD93 + len(x)) & 0xFFFFFFFFFFFFFFFF
    return total - (total >> 63 << 64) if len(x) else 0


def _bitmap(x: np.ndarray) -> bytes:
    """Parities of the tokens' counts by hash; twice as many bits as tokens, at least 64. Folding halves the size and stays right."""
    size = max(64, 1 << int(2 * len(x) - 1).bit_length())
    count = np.bincount((mix(x) & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(count.astype(bool), bitorder="little").tobytes()


def _need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of sets of a and b tokens that reaches the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def shingle_sets(docs: DataFrame, often, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, print, head, bitmap) of each row of ``docs``; ``head`` stands for the prefix and size. A null or text without words has size 0."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = often.value
        for batch in slices(batches):
            got = [(len(x), _print(x), _head(x, tokens, ranks, percent)[1], _bitmap(x)) if len(x) else (0, 0, 0, b"") for _, words in chunks(batch.column(1), True) for x in _sets(words, k)]
            n, prints, heads, bitmap = zip(*got) if got else ((), (), (), ())
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, prints, heads)), pa.array(bitmap, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print", "head", "bitmap"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(size, "doc_id long, n_shingles long, print long, head long, bitmap binary")


def frequent_tokens(docs: DataFrame, k: int = SHINGLE, most: int | None = None) -> np.ndarray:
    """At most ``most`` of the tokens that most sets have, rarest first; counted within each slice of rows (what is there once is left out), then over all.

    By default two for each row, FREQUENT at least and MOST_FREQUENT at most.
    Any list is right; a longer one keeps more common passages out of prefixes.
    """
    most = most or min(MOST_FREQUENT, max(FREQUENT, 2 * docs.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [x for _, words in chunks(batch.column(0), True) for x in _sets(words, k)]
            if not got:
                continue
            x = np.concatenate(got)
            x.sort()
            cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
            n = np.diff(np.r_[cuts, len(x)])
            many = np.flatnonzero(n > 1)
            many = many[np.argsort(-n[many], kind="stable")[:most]]
            yield pa.RecordBatch.from_arrays([pa.array(x[cuts[many]].view(np.int64)), pa.array(n[many], pa.int64())], ["token", "n"])

    with Scratch(docs.sparkSession, "frequent") as scratch:
        rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > SHORT_LIST)
        return _most_frequent(materialize(rows, "tokens", scratch), most)


def crowded_tokens(docs: DataFrame, token: np.ndarray, k: int = SHINGLE, percent: int = PERCENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """``token``, a list of frequent_tokens, led by further tokens, rarest first, that more than SHORT_LIST different prefixes by it hold; at most ``most`` in all.

    A slice of rows seldom holds twice what a few in a hundred thousand have, so that frequent_tokens
    miss it; prefixes are few enough to count whole. Long lists of such tokens would chain most of a large table.
    """
    spark = docs.sparkSession
    order = np.argsort(token)
    often = spark.sparkContext.broadcast((token[order], order))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = U(64 - bucket_bits(spark, size))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = often.value
        for batch in slices(batches):
            heads = {group: head for _, words in chunks(batch.column(0), True) for x in _sets(words, k) if len(x) for head, group in [_head(x, tokens, ranks, percent)]}
            if heads:
                x = np.concatenate(list(heads.values()))
                rows = list(bucket_rows((mix(x) >> shift).astype(np.int64), x))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1][0] for r in rows], pa.binary())], ["bucket", "token"])

    def count(table: pa.Table) -> pa.Table:
        x, n = np.unique(np.frombuffer(b"".join(table["token"].to_pylist()), np.uint64), return_counts=True)
        return pa.table({"token": pa.array(x[n > SHORT_LIST].view(np.int64)), "n": pa.array(n[n > SHORT_LIST], pa.int64())})

    with Scratch(spark, "prefixes") as scratch:
        rows = docs.select("text").mapInArrow(deal, "bucket int, token binary").groupBy("bucket").applyInArrow(count, "token long, n long")
        more = _most_frequent(materialize(rows, "tokens", scratch), most - len(token))
    often.unpersist()
    more = more[~np.isin(more, token)]
    return np.concatenate([more, token])


def _most_frequent(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` tokens of a stored table (token, n), rarest first. No task sorts them: of the count that would pass the bound, the smallest stay."""
    steps = rows.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).toArrow()  # a row a count
    n, total = np.asarray(steps.column(0)), np.cumsum(np.asarray(steps.column(1)))
    if len(n) and total[-1] > most:
        at = int(np.argmax(total > most))
        ties = rows.where(F.col("n") == int(n[at])).orderBy("token").limit(most - int(np.r_[0, total][at]))
        rows = rows.where(F.col("n") > int(n[at])).unionByName(ties)
    got = rows.toArrow()  # a bounded list
    token, n = (np.asarray(got.column(k), np.int64) for k in (0, 1))
    return token[np.lexsort((-token, n))].view(np.uint64)


def _ordered(x: np.ndarray, token: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: rare tokens by hash, then frequent ones by rank."""
    if not len(token) or not len(x):
        return x
    at = np.minimum(np.searchsorted(token, x), len(token) - 1)
    often = token[at] == x
    if not often.any():
        return x
    late = x[often][np.argsort(rank[at[often]], kind="stable")]
    return np.concatenate([x[~often], late])


def _head(x: np.ndarray, token: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set, and the group of sets with this prefix and size."""
    head = _ordered(x, token, rank)[: _prefix_length(len(x), percent)]
    return head, _print(np.append(head, U(len(x))))


def similar_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of
    distinct k-word shingles (A-Z lower-cased; words are runs of other than ASCII
    white space; a text of fewer words is one shingle). A text that is null or has
    no words has an empty set and links with nothing. ``component_id`` is the
    smallest doc_id reachable. Repeated rows and repeated ids are kept as they
    are; rows without doc_id keep a null component and take no part.
    """
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        return materialize(_classes(docs, k, percent, scratch), "classes")


def _classes(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    token = crowded_tokens(docs, frequent_tokens(docs, k), k, percent)
    order = np.argsort(token)
    often = spark.sparkContext.broadcast((token[order], order))  # at most MOST_FREQUENT tokens
    sets = materialize(shingle_sets(docs, often, k, percent), "sets", scratch)
    own = [F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("head").alias("head"), F.first("bitmap").alias("bitmap")]
    distinct = sets.where("n_shingles > 0 and doc_id is not null").groupBy("print").agg(*own)
    distinct = materialize(distinct, "distinct", scratch)
    links = _set_links(docs, distinct, often, k, percent, scratch)
    # An id of several texts joins their sets.
    several = sets.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high").select("doc_id")
    own = sets.select("doc_id", "print").where("n_shingles > 0").join(several, "doc_id", "left_semi").join(distinct.select("print", F.col("doc_id").alias("b")), "print")
    links = links.unionByName(own.select(F.col("doc_id").alias("a"), "b"))
    names = connected_components(links)
    least = distinct.select("print", F.col("doc_id").alias("node")).join(names, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    own = sets.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("print")).alias("print"))
    own = own.join(least, "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return own


def _set_links(docs: DataFrame, distinct: DataFrame, often, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between representatives' doc_ids, enough to give the components."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(spark, size)  # what is dealt is about as large as the texts
    shift = U(64 - bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = often.value
        for batch in slices(batches):
            own: dict[int, int] = {}
            parts = []
            for _, words in chunks(batch.column(0), True):
                for x in _sets(words, k):
                    if len(x):
                        head, group = _head(x, tokens, ranks, percent)
                        if group not in own:
                            own[group] = len(x)
                            parts.append(head)
            if not parts:
                continue
            length = np.array([len(x) for x in parts])
            which = np.repeat(np.arange(len(parts)), length)
            place = np.arange(len(which)) - (np.cumsum(length) - length)[which]
            t = mix(np.concatenate(parts))
            group, size = np.array(list(own), np.int64)[which], np.array(list(own.values()), np.uint32)[which]
            # In a bucket, 32 further bits stand for the token; the rare false match is verified away.
            rows = list(bucket_rows((t >> shift).astype(np.int64), t.astype(np.uint32), group, size, np.minimum(place, 65535).astype(np.uint16)))
            columns = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[1][i] for r in rows], pa.binary()) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "token", "head", "size", "place"])

    def meet(table: pa.Table) -> pa.Table:
        t, p, n, place = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("token", np.uint32), ("head", np.int64), ("size", np.uint32), ("place", np.uint16)))
        order = np.lexsort((p, n, t))
        t, p, n, place = t[order], p[order], n[order].astype(np.int64), place[order].astype(np.int64)
        fresh = np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1])]
        t, p, n, place = t[fresh], p[fresh], n[fresh], place[fresh]
        cuts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        long_ = np.diff(np.r_[cuts, len(t)])
        short = (long_ > 1) & (long_ <= SHORT_LIST)
        x, y = [], []
        for gap in range(1, SHORT_LIST):
            i = np.concatenate([cuts[short & (long_ == m)][:, None] + np.arange(m - gap) for m in range(gap + 1, SHORT_LIST + 1)], axis=None).astype(np.int64)
            x.append(i)
            y.append(i + gap)
        x, y = np.concatenate(x), np.concatenate(y)
        near = 100 * n[x] >= percent * n[y]
        x, y = x[near], y[near]
        near = np.minimum(n[x] - place[x], n[y] - place[y]) >= _need(n[x], n[y], percent)  # of the first common token, an upper bound
        x, y = x[near], y[near]
        pair = np.unique(np.stack([np.minimum(p[x], p[y]), np.maximum(p[x], p[y])], 1), axis=0)
        # In a long list, groups chain that may have a partner in it by the same bound, with the smallest size that can be one.
        smallest = np.maximum(-(-percent * n // 100), np.repeat(n[cuts], long_))
        open_ = np.flatnonzero(np.repeat(long_ > SHORT_LIST, long_) & (n - place >= _need(n, smallest, percent)))
        one, two = open_[:-1], open_[1:]
        chained = (t[one] == t[two]) & (100 * n[one] >= percent * n[two])
        one, two = one[chained], two[chained]
        ids, index = np.unique(p[np.r_[one, two]], return_inverse=True)
        root = forest(len(ids), index[: len(one)], index[len(one) :])
        far = np.flatnonzero(root != np.arange(len(ids)))
        a = np.r_[pair[:, 0], ids[root[far]]]
        b = np.r_[pair[:, 1], ids[far]]
        kind = np.r_[np.zeros(len(pair), np.int8), np.ones(len(far), np.int8)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "chained": pa.array(kind == 1)})

    rows = docs.select("text").mapInArrow(deal, "bucket int, token binary, head binary, size binary, place binary")
    met = rows.groupBy("bucket").applyInArrow(meet, "a long, b long, chained boolean").distinct()
    met = materialize(met, "met", scratch)
    # Groups of several sets are compared as clusters, with all that their group pairs with.
    crowded = distinct.groupBy("head").agg(F.count("*").alias("m")).where("m > 1").select("head")
    crowded = materialize(crowded, "crowded", scratch)
    for end in "ab":
        met = met.join(crowded.select(F.col("head").alias(end), F.lit(True).alias(f"crowded_{end}")), end, "left")
    met = materialize(met.select("a", "b", (F.col("chained") | F.coalesce("crowded_a", "crowded_b", F.lit(False))).alias("chained")), "met", scratch)
    bound = materialize(_bounded(met.where("not chained").select("a", "b"), distinct, percent), "pairs", scratch)
    clusters = connected_components(met.where("chained")).select(F.col("node").alias("head"), F.col("component").alias("cluster"))
    clusters = clusters.unionByName(crowded.join(clusters, "head", "left_anti").select("head", F.col("head").alias("cluster")))
    clusters = materialize(clusters, "clusters", scratch)
    paired = bound.select(F.col("a").alias("head")).union(bound.select(F.col("b").alias("head"))).distinct().withColumn("paired", F.lit(True))
    chosen = distinct.join(paired, "head", "left").join(clusters, "head", "left").where("paired or cluster is not null").select("doc_id", "print", "head", "n", "cluster", "paired", "bitmap")
    chosen = _finer(materialize(chosen, "members", scratch), percent, scratch).where("paired or cluster is not null").drop("paired")
    chosen = materialize(_blocks(materialize(chosen, "finer", scratch), percent), "chosen", scratch)
    whole = materialize(_whole_sets(docs, chosen, k), "whole", scratch)
    direct = _verified(bound, whole, percent)
    return direct.unionByName(_cluster_links(whole, percent, scratch))


def _size_class(percent: int) -> Column:
    """Sets that can link are of one class or of neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))


def _large(members: DataFrame) -> DataFrame:
    """Clusters of more than BLOCK_TOKENS tokens or BLOCK_ROWS sets."""
    totals = members.where("cluster is not null").groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("m"))
    return totals.where((F.col("total") > BLOCK_TOKENS) | (F.col("m") > BLOCK_ROWS)).select("cluster")


def _finer(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``members`` (without bitmap) with large clusters divided into the components that the bitmaps' bound allows; what is alone in one goes."""
    large = materialize(_large(members), "large", scratch)
    inside = members.join(large, "cluster", "left_semi").withColumn("class", _size_class(percent))
    sizes = inside.groupBy("cluster", "class").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    inside = inside.join(sizes, ["cluster", "class"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), "parts"))
    packed = inside.groupBy("cluster", "class", "block").agg(F.collect_list(F.struct("doc_id", "n", "bitmap")).alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    pairs = units(materialize(packed, "bitmaps", scratch), ["cluster"], ["members"], percent)

    def compare(table: pa.Table) -> pa.Table:
        blocks = [x.as_py() for x in table["members"]]
        return _pairs_table([_bitmap_links(blocks[i], blocks[j], percent) for i, j in block_pairs(table["side"].to_pylist())])

    parts = connected_components(pairs.groupBy("unit").applyInArrow(compare, "a long, b long")).select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
    split = members.join(large.withColumn("_large", F.lit(True)), "cluster", "left").join(parts, "doc_id", "left").drop("bitmap")
    return split.withColumn("cluster", F.when(F.col("_large"), F.col("part")).otherwise(F.col("cluster"))).drop("_large", "part")


def _pairs_table(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate([f[i] for f in found] + [np.zeros(0, np.int64)]) for i in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _bitmap_links(one: list[dict], two: list[dict], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs that the parity bitmaps' bound allows, as ids."""
    width = min(len(m["bitmap"]) for m in one + two) // 8

    def folded(rows: list[dict]) -> np.ndarray:
        return np.stack([np.bitwise_xor.reduce(np.frombuffer(m["bitmap"], np.uint64).reshape(-1, width), axis=0) for m in rows])

    a, b = folded(one), folded(two)
    na, nb = (np.array([m["n"] for m in rows], np.int64) for rows in (one, two))
    ids = np.array([m["doc_id"] for m in one + two], np.int64)
    x, y = [], []
    for i in range(len(one)):
        differ = np.bitwise_count(a[i] ^ b).sum(1, dtype=np.int64)
        hit = np.flatnonzero((na[i] + nb - differ) // 2 >= _need(na[i], nb, percent))
        x.append(np.full(len(hit), i))
        y.append(len(one) + hit)
    nodes, index = np.unique(ids, return_inverse=True)
    root = forest(len(nodes), index[np.concatenate(x)], index[np.concatenate(y)])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[far]], nodes[far]


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """``members`` with ``class`` and ``block``: a large cluster is cut by size classes and then by hash; ``class`` is null for one that stays whole."""
    inside = members.join(_large(members), "cluster", "left_semi").withColumn("class", _size_class(percent))
    parts = inside.groupBy("cluster", "class").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_ROWS)).alias("parts"))
    out = members.withColumn("class", _size_class(percent)).join(parts, ["cluster", "class"], "left")
    return out.withColumn("block", F.pmod(F.xxhash64("doc_id"), "parts")).withColumn("class", F.when(F.col("parts").isNotNull(), F.col("class"))).drop("parts")


def _bounded(pairs: DataFrame, distinct: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups whose sets' parity bitmaps allow the overlap that is needed."""
    own = distinct.select("head", "n", "bitmap")
    both = pairs.join(own.select(F.col("head").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba")), "a")
    both = both.join(own.select(F.col("head").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb")), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ba, bb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "na", "nb", "ba", "bb"))
            ok = []
            for i in range(len(a)):
                x, y = np.frombuffer(ba[i], np.uint64), np.frombuffer(bb[i], np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                differ = int(np.bitwise_count(x ^ y).sum())
                ok.append((na[i] + nb[i] - differ) // 2 >= -(-percent * (na[i] + nb[i]) // (100 + percent)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in "ab"], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(keep, "a long, b long")


def _whole_sets(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """``chosen`` with ``tokens``, the whole set, of the chosen representatives. A bit set, sixteen bits a representative up to a bound, keeps most other texts from being split again."""
    spark = docs.sparkSession
    size = 1 << min(MOST_FILTER, max(LEAST_FILTER, math.ceil(math.log2(16 * chosen.count() + 1))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            x = mix(np.asarray(batch.column(0)).view(np.uint64))
            bits[(x & U(size - 1)).astype(np.int64)] = True
        slices = np.packbits(bits).reshape(256, -1)
        some = np.flatnonzero(slices.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([slices[i].tobytes() for i in some], pa.binary())], ["slice", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    bits = np.zeros((256, size >> 11), np.uint8)
    for row in chosen.select("doc_id").mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary").collect():  # ``size`` bits in all
        bits[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    seen = spark.sparkContext.broadcast(bits.reshape(-1))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seen.value
        for batch in slices(batches):
            at = (mix(np.asarray(batch.column(0)).view(np.uint64)) & U(size - 1)).astype(np.int64)
            batch = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1) > 0))
            got = [(_print(x), x.tobytes()) for _, words in chunks(batch.column(1), True) for x in _sets(words, k)]
            prints, tokens = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "print", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(gather, "doc_id long, print long, tokens binary")
    return chosen.join(rows.dropDuplicates(["doc_id", "print"]), ["doc_id", "print"])


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(a, b) as doc_ids of the pairs of groups of one set each that reach the threshold."""
    left = whole.select(F.col("head").alias("a"), F.col("doc_id").alias("ida"), F.col("tokens").alias("ta"))
    right = whole.select(F.col("head").alias("b"), F.col("doc_id").alias("idb"), F.col("tokens").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ida, idb = (batch.column(batch.schema.get_field_index(c)) for c in ("ida", "idb"))
            ta, tb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ta", "tb"))
            ok = []
            for x, y in zip(ta, tb):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                z = np.concatenate([x, y])
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                ok.append(100 * common >= percent * (len(z) - common))
            yield pa.RecordBatch.from_arrays([ida, idb], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("ida", "idb", "ta", "tb").mapInArrow(check, "a long, b long")


def _cluster_links(whole: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) as doc_ids: a spanning forest of the links inside each cluster; large ones are compared block by block."""
    inside = whole.where("cluster is not null")
    member = F.collect_list(F.struct("doc_id", "tokens")).alias("members")
    small = inside.where("class is null").groupBy("cluster").agg(member).select("members")
    packed = inside.where("class is not null").groupBy("cluster", "class", "block").agg(member, F.min("n").alias("low"), F.max("n").alias("high"))
    pairs = units(materialize(packed, "blocks", scratch), ["cluster"], ["members"], percent)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [_unpacked(x.as_py()) for x in batch.column(0)]
            yield from _pairs_table([_token_links(x, x, percent) for x in blocks]).to_batches()

    def compare(table: pa.Table) -> pa.Table:
        blocks = [_unpacked(x.as_py()) for x in table["members"]]
        return _pairs_table([_token_links(blocks[i], blocks[j], percent) for i, j in block_pairs(table["side"].to_pylist())])

    schema = "a long, b long"
    return small.mapInArrow(alone, schema).unionByName(pairs.groupBy("unit").applyInArrow(compare, schema))


def _unpacked(members: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.array([m["doc_id"] for m in members], np.int64), [np.frombuffer(m["tokens"], np.uint64) for m in members]


def _token_links(one: tuple[np.ndarray, list[np.ndarray]], two: tuple[np.ndarray, list[np.ndarray]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs of two blocks that reach the threshold, as ids; overlaps by products of 0-1 matrices."""
    (ids_a, a), (ids_b, b) = one, two
    ids = np.concatenate([ids_a, ids_b])
    sizes = np.array([len(x) for x in a + b])
    tokens = np.concatenate(a + b)
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    cuts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    runs = np.diff(np.r_[cuts, len(tokens)])
    shared = np.repeat(runs > 1, runs)
    column = np.repeat(np.cumsum(runs > 1) - 1, runs)[shared]
    common = np.zeros((len(a), len(b)), np.float32)
    owner = owner[shared]
    width = max(64, DENSE // max(len(ids), 1))
    for at in range(0, int((runs > 1).sum()), width):
        x, y = np.searchsorted(column, (at, at + width))
        dense = np.zeros((len(ids), width), np.float32)
        dense[owner[x:y], column[x:y] - at] = 1
        common += dense[: len(a)] @ dense[len(a) :].T
    union = sizes[: len(a), None] + sizes[None, len(a) :] - common
    x, y = np.nonzero(100 * common >= percent * union)
    nodes, index = np.unique(ids, return_inverse=True)
    root = forest(len(nodes), index[x], index[len(a) + y])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[far]], nodes[far]


def keep_one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that another of their component stands for: the one with the smallest doc_id stays.

    Rows without doc_id stay; of repeated rows with the staying id, all stay that are
    equal in doc_id (they are one document).
    """
    classes = similar_documents(docs, k, percent)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
