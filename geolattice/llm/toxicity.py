"""Toxicity by gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features: densities of a learned lexicon (words whose share among toxic texts is
much higher than among others) and of its hits close to a second-person word,
capitals, exclamation and question marks, other punctuation, and obfuscation
(digits or symbols inside words, stretched letters, letters spelled one by one).
All are counted over the texts' UTF-8 bytes at once; words are compared by hash,
after look-alike digits and symbols are read as letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .boosting import Booster, Isotonic
from .session import hashed_sample, others, schema_of, unused
from .wordhash import U, mix

SAMPLE, SAMPLE_BYTES = 5000, 64 << 20
LEXICON = 2000
NEAR = 6
# Second-person words of the corpora's languages, and the characters that often stand for letters.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros".split()
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LEAD = np.zeros(256, bool)  # first byte of a letter
_LEAD[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STAND = _DIGIT.copy()
_STAND[[ord(c) for c in "@$*"]] = True
_PART = _LETTER | _STAND  # bytes of words
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _a, _b in LOOKALIKES.items():
    _FOLD[ord(_a)] = ord(_b)
NAMES = (
    "lexicon share", "lexicon hits", "distinct hits", "weak share", "near share", "near hits", "capitals", "shouted",
    "exclamations", "questions", "punctuation", "mixed", "stretched", "spelled", "digits", "length",
)


@dataclass
class _Marks:
    """Words and character counts of a chunk of texts; ``first`` as in wordhash.Words."""

    hashes: np.ndarray
    first: np.ndarray
    rates: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return np.diff(total[offsets])


def _marks(data: np.ndarray, offsets: np.ndarray) -> _Marks:
    n = len(data)
    size = np.maximum(np.diff(offsets), 1)
    part, lead = _PART[data], _LEAD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~part[:-1]
    after[:-1] = ~part[1:]
    starts = np.flatnonzero(part & (before | edge[:-1]))
    ends = np.flatnonzero(part & (after | edge[1:])) + 1
    folded = _FOLD[data]
    accent = np.flatnonzero(data[:-1] == 0xC3) + 1 if n else np.zeros(0, np.int64)
    capital = accent[(data[accent] >= 0x80) & (data[accent] <= 0x9E)]
    folded[capital] += 32
    up, down = wordhash._powers(wordhash._BASE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(wordhash._BYTE[folded] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    upper = (data >= 65) & (data <= 90)
    upper[capital] = True
    letters = np.maximum(_sums(lead, offsets), 1)
    words = np.maximum(np.diff(first), 1)
    ups = np.zeros(n + 1, np.int64)
    np.cumsum(upper, out=ups[1:])
    width = ends - starts
    shouted = (width >= 3) & (ups[ends] - ups[starts] >= width - (width > 3))
    letter, stand = _LETTER[data], _STAND[data]
    mixed, stretched = np.zeros(n, bool), np.zeros(n, bool)
    if n > 2:
        mixed[1:-1] = letter[:-2] & stand[1:-1] & letter[2:] & ~edge[1 : n - 1] & ~edge[2:n]  # not across texts
        stretched[2:] = letter[2:] & (folded[2:] == folded[1:-1]) & (folded[1:-1] == folded[:-2]) & (data[2:] < 128) & ~edge[1 : n - 1] & ~edge[2:n]
    single = width == 1
    single &= letter[starts]
    spelled = np.zeros(len(starts), bool)
    if len(starts) > 3:
        close = np.zeros(len(starts), bool)
        close[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1)
        close[first[:-1][first[:-1] < len(starts)]] = False
        spelled[3:] = close[3:] & close[2:-1] & close[1:-2]
    rates = np.stack(
        [
            _sums(upper, offsets) / letters,
            _sums(shouted, first) / words,
            _sums(data == 33, offsets) / size,
            _sums(data == 63, offsets) / size,
            _sums(~part & ~wordhash._IS_SPACE[data], offsets) / size,
            _sums(mixed, offsets) / words,
            _sums(stretched, offsets) / words,
            _sums(spelled, first) / words,
            _sums(_DIGIT[data], offsets) / size,
            np.log1p(words),
        ],
        1,
    )
    return _Marks(hashes, first, rates)


def _all_marks(column: pa.Array) -> Iterator[_Marks]:
    for _, data, offsets in wordhash.raw_chunks(column):
        yield _marks(data, offsets)


def hash_words(words: list[str]) -> np.ndarray:
    """Sorted hashes of words, as texts' words are hashed."""
    marks = list(_all_marks(pa.array([" ".join(words)])))
    return np.unique(np.concatenate([m.hashes for m in marks])) if words else np.zeros(0, np.uint64)


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


@dataclass
class Model:
    """Everything that scoring needs; of bounded size. One that has not seen both labels gives every text 0."""

    strong: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weak: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    booster: Booster = field(default_factory=Booster)
    calibration: Isotonic = field(default_factory=Isotonic)
    learned: bool = False

    def features(self, marks: _Marks) -> np.ndarray:
        words = np.maximum(marks.counts, 1)
        strong = _member(marks.hashes, self.strong)
        hits = _sums(strong, marks.first)
        weak = _sums(_member(marks.hashes, self.weak), marks.first)
        at = np.flatnonzero(strong)
        doc = np.searchsorted(marks.first, at, "right") - 1
        person = np.flatnonzero(_member(marks.hashes, _PERSON))
        near = np.zeros(len(words), np.int64)
        distinct = np.zeros(len(words), np.int64)
        if len(at):
            pair = np.unique(np.stack([doc.astype(np.uint64), marks.hashes[at]], 1), axis=0)
            np.add.at(distinct, pair[:, 0].astype(np.int64), 1)
            if len(person):
                place = np.searchsorted(person, at)
                close = np.zeros(len(at), bool)
                for other in (person[np.maximum(place - 1, 0)], person[np.minimum(place, len(person) - 1)]):
                    close |= (np.abs(other - at) <= NEAR) & (other >= marks.first[doc]) & (other < marks.first[doc + 1])
                np.add.at(near, doc[close], 1)
        return np.column_stack([hits / words, hits, distinct, weak / words, near / words, near, marks.rates])

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.learned:
            return np.zeros(len(column))
        parts = [self.booster.log_odds(self.features(m)) for m in _all_marks(column)]
        return np.clip(self.calibration.map(np.concatenate(parts)), 0, 1) if parts else np.zeros(0)


_PERSON = hash_words(SECOND_PERSON)


def learn(texts: list[str], toxic: np.ndarray) -> Model:
    """Lexicon and trees by folds, so that neither the trees' features nor the calibration see a row's own label."""
    if not len(toxic) or toxic.min() == toxic.max():
        return Model()
    marks = [m for i in range(len(texts)) for m in _all_marks(pa.array(texts[i : i + 1], pa.string()))]
    bags = [np.unique(m.hashes) for m in marks]
    fold = np.arange(len(texts)) % 3
    original = _originals(bags)

    def lexicon(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sides = []
        for side in (1, 0):
            rows = np.flatnonzero(keep & original & (toxic == side))
            found = np.unique(np.concatenate([bags[i] for i in rows] or [np.zeros(0, np.uint64)]), return_counts=True)
            sides.append((*found, len(rows)))
        (word, bad, n_bad), (other, good, n_good) = sides
        word, bad = word[bad >= 4], bad[bad >= 4]
        at = np.minimum(np.searchsorted(other, word), max(len(other) - 1, 0))
        count = np.where(other[at] == word, good[at], 0) if len(other) else np.zeros(len(word))
        odds = (bad + 0.5) / (n_bad + 1) / ((count + 0.5) / (n_good + 1))
        order = np.lexsort((word, -odds * np.log1p(bad)))[:LEXICON]
        strong = (odds >= 20) & (bad >= max(8, 0.02 * n_bad))
        return np.sort(word[order][strong[order]]), np.sort(word[order][~strong[order] & (odds[order] >= 4)])

    x = np.empty((len(texts), len(NAMES)))
    for k in range(3):
        own = np.flatnonzero(fold == k)
        part = Model(*lexicon(fold != k))
        x[own] = np.concatenate([part.features(marks[i]) for i in own])
    scores = np.empty(len(texts))
    for k in range(3):
        own = fold == k
        scores[own] = _trees().fit(x[~own], toxic[~own]).log_odds(x[own])
    return Model(*lexicon(np.ones(len(texts), bool)), _trees().fit(x, toxic), Isotonic().fit(scores, toxic.astype(float)), True)


def _originals(bags: list[np.ndarray]) -> np.ndarray:
    """Marks the texts that are no near copies of earlier ones, so that a word counts once for a group of copies."""
    word, count = np.unique(np.concatenate(bags), return_counts=True)
    common = word[count > max(8, len(bags) // 20)]
    seen: dict[tuple[int, int], list[int]] = {}
    keep = np.zeros(len(bags), bool)
    for i, bag in enumerate(bags):
        rare = bag[~_member(bag, common)]
        places = [(k, int(mix(rare ^ U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min())) for k in range(6)] if len(rare) else [(0, 0)]
        near = {j for p in places for j in seen.get(p, ())}
        keep[i] = not any(2 * len(np.intersect1d(bag, bags[j], assume_unique=True)) >= len(bag) + len(bags[j]) - len(np.intersect1d(bag, bags[j], assume_unique=True)) for j in near)
        if keep[i]:
            for p in places:
                seen.setdefault(p, []).append(i)
    return keep


def _trees() -> Booster:
    return Booster(rounds=40, leaves=8, rate=0.2, least=20, ridge=5.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from at most ``sample`` labelled rows, and ``sample_bytes`` of their texts, whose crc32(doc_id) mod 5 is not 0, the first by hash of the id.

    Null labels, ids and texts are left out; of several labels of an id the largest
    counts. Without rows of both labels there is nothing to tell apart: all scores are 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = hashed_sample(known, F.col("doc_id"), sample).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample).collect()  # at most ``sample`` pairs
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in rows], "doc_id long, toxic int")
    found = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    order = (F.xxhash64("doc_id", F.lit(4)), F.col("doc_id"), F.xxhash64("text"))
    got, held = [], 0
    for r in found.where(F.octet_length("text") <= sample_bytes // 8).orderBy(*order).limit(sample).toLocalIterator():  # bounded in rows, and below in bytes
        held += len(r["text"])
        if held > sample_bytes:
            break
        got.append(r)
    return learn([r["text"] for r in got], np.array([r["toxic"] > 0 for r in got], np.int64))


def score_documents(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; higher means toxic is likelier) and ``predicted`` (1 from 0.5 on), of whole texts.

    A null text counts as empty and gets the score of no words; a model that
    learned nothing gives all 0. Rows are judged one by one, repeated ones alike.
    Other columns are passed through, columns of these two names, in any case,
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicon and trees, of bounded size
    names = others(docs, score, predicted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            values = own.score(batch.column(batch.schema.get_field_index("text")))
            out = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32))], [*names, score, predicted])

    return docs.mapInArrow(run, schema_of(docs, names, f"`{score}` double, `{predicted}` int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier predicts toxic.

    All columns pass, whatever their names. Null and empty texts are judged as texts
    without words; repeated rows go or stay together. Without labels of both kinds
    nothing can be told, and all documents stay.
    """
    score, predicted = unused(docs, "toxic_score"), unused(docs, "toxic_predicted")
    return score_documents(docs, fit(docs, labels), score, predicted).where(F.col(predicted) == 0).select(docs.columns)
