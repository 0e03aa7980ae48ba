"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into a fixed number of buckets.
Document frequencies come from all rows that may be learned from; the weights
from a bounded sample of labelled rows by follow-the-regularised-leader with
elastic-net penalties (the L1 part keeps them sparse); a temperature, fitted on
sampled rows that training did not see, calibrates the probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import others, schema_of

BITS = 14
SAMPLE, SAMPLE_BYTES, MOST_LANGUAGES = 4000, 64 << 20, 256
EPOCHS = 3
HELD_OUT = 2
PIECE = 1 << 20
_letter = regex.compile(r"\p{L}").search


def ngram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of the hashed n-grams (1 to 3) of the lower-cased text, a space before it and after it."""
    size = 1 << bits
    total = np.zeros(size, np.int64)
    text = " " + text.lower() + " "
    for at in range(0, max(1, len(text) - 2), PIECE):  # long texts by pieces that overlap by two characters
        x = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        last = at + PIECE + 2 >= len(text)
        n = len(x) if last else PIECE
        h = (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        total += np.bincount(h[:n], minlength=size)
        two = x[:-1] * np.uint32(0x85EBCA6B) + x[1:]
        total += np.bincount((two[:n] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=size)
        three = two[:-1] * np.uint32(0xC2B2AE35) + x[2:]
        total += np.bincount((three[:n] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=size)
    return total


@dataclass
class Model:
    """Everything that prediction needs; of bounded size."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets that occur, and their TF-IDF values scaled to length 1."""
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        return at, x / (np.sqrt(x @ x) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability; ``und`` and 0 if the text has no letter or nothing was learned."""
        if not text or not self.languages or not _letter(text):
            return "und", 0.0
        at, x = self.vector(ngram_counts(text))
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


class FollowTheLeader:
    """FTRL-proximal for the softmax loss, per-coordinate steps, L1 and L2 penalties."""

    def __init__(self, features: int, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        score = x @ w
        p = np.exp(score - score.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def learn(idf: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Model:
    """``counts``: (buckets, counts) of each sampled row. Every fifth row is kept for the temperature."""
    model = Model(sorted(set(labels)), idf)
    k = len(model.languages)
    model.weights, model.bias = np.zeros((len(idf), k)), np.zeros(k)
    if k < 2:
        return model
    number = {x: i for i, x in enumerate(model.languages)}
    rows = []
    for (at, c), label in zip(counts, labels):
        x = np.log1p(c) * idf[at]
        rows.append((np.append(at, len(idf)), np.append(x / (np.sqrt(x @ x) or 1.0), 1.0), number[label]))
    kept = [r for i, r in enumerate(rows) if i % 5 == 4] or rows
    seen = [r for i, r in enumerate(rows) if i % 5 != 4]
    leader = FollowTheLeader(len(idf) + 1, k)
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(seen)):
            leader.step(*seen[i])
    w = leader.weights(slice(None))
    model.weights, model.bias = w[:-1], w[-1]
    z = np.array([x @ w[at] for at, x, _ in kept])
    y = np.array([r[2] for r in kept])

    def loss(t: float) -> float:
        s = z / t
        s -= s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: with id, text and lang, and crc32(doc_id) mod 4 other than HELD_OUT."""
    return docs.where("doc_id is not null and text is not null and lang is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT)


def shares(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """Rows to take of each language: half of the sample in equal parts, as far as there are rows, the rest by size."""
    floor = {x: min(n, max(1, sample // (2 * len(sizes)))) for x, n in sizes.items()}
    spare, total = sample - sum(floor.values()), sum(sizes.values())
    return {x: min(n, floor[x] + spare * n // total) for x, n in sizes.items()}


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from ``learnable(docs)``: frequencies from all of it, weights from ``sample`` rows and ``sample_bytes`` of their counts at most.

    Rows are chosen by hash of doc_id within each language, so that rare ones are
    learned too; of more than MOST_LANGUAGES values of lang the most common are.
    """
    rows = learnable(docs)
    size = 1 << BITS

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df += ngram_counts(text.as_py()) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["bucket", "df"])

    found = rows.select("text").mapInArrow(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()  # 2**BITS + 1 rows
    df = np.zeros(size)
    n = 0
    for r in found:
        if r["bucket"] < 0:
            n = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    idf = np.log((n + 1) / (df + 1)) + 0.1

    if not n:
        return Model(idf=idf)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [ngram_counts(t.as_py()) for t in batch.column(2)]
            where = [np.flatnonzero(c) for c in got]
            packed = ([w.astype(np.int32).tobytes() for w in where], [c[w].astype(np.int32).tobytes() for c, w in zip(got, where)])
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in packed)]
            yield pa.RecordBatch.from_arrays(columns, ["at", "lang", "buckets", "counts"])

    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()  # a bounded list
    wanted = shares({r["lang"]: r["n"] for r in sizes}, sample)
    of = {r["lang"]: min(1.0, (wanted[r["lang"]] + 4 * wanted[r["lang"]] ** 0.5 + 4) / r["n"]) for r in sizes}
    table = docs.sparkSession.createDataFrame([(x, min((1 << 63) - 1, int(of[x] * (1 << 63)))) for x in wanted], "lang string, below long")
    # Tasks keep little more than is wanted, by the hash's size; then the first of each language count.
    own = rows.select(F.xxhash64("doc_id", F.lit(2)).alias("at"), "lang", "text").join(F.broadcast(table), "lang").where(F.shiftrightunsigned("at", 1) <= F.col("below"))  # MOST_LANGUAGES rows
    chosen = own.select("at", "lang", "text").mapInArrow(count, "at long, lang string, buckets binary, counts binary")
    got, taken, held = [], Counter(), 0
    for r in chosen.orderBy("at", "lang", "buckets", "counts").limit(2 * sample).toLocalIterator():  # bounded in rows, and below in bytes
        held += len(r["buckets"]) + len(r["counts"])
        if held > sample_bytes:
            break
        if taken[r["lang"]] < wanted[r["lang"]]:
            taken[r["lang"]] += 1
            got.append(r)
    return learn(idf, [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in got], [r["lang"] for r in got])


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the language's calibrated probability) of each whole text.

    ``und`` and 0 if the text is null, empty or has no letter, or if no labelled
    row could be learned from. Rows are judged one by one, repeated ones alike.
    Other columns pass; those of these names, in any case, are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a language
    names = others(docs, "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            langs, scores = zip(*got) if got else ((), ())
            out = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema_of(docs, names, "lang_pred string, score double"))
