"""Benchmark decontamination, in DataFrame functions only.

1. A text becomes an array of 5-word shingle hashes. Windows are as long as an
   item and start at every word.
2. A window that reaches the threshold misses at most a known share of an item's
   weight, so it holds one of the item's rarest shingles: of those sorted by weight
   and heavier together than that share (its *lead*). Texts meet items by an
   equi-join on leads, and every window around such a place is a candidate; no
   pair that reaches the threshold is lost.
3. Candidates are verified by the exact similarity of their shingle sets, weighted:
   a shingle weighs less the more items hold it.

SimHash fingerprints in Hamming blocks were asked for. They can't give whole
results: fingerprints of pairs at the threshold lie 20 and more of 64 bits apart,
and blocks that find all of these would hold two bits each (the README has
figures). Step 2 takes their place.

Texts never leave their rows: one scan, and only candidates are shuffled. Leads are
broadcast, up to a bound; a larger benchmark goes in blocks of items, with a scan
for each.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Scratch
from .session import materialize, unused

SHINGLE, THRESHOLD = 5, 0.75
SET_BOUND = 1 << 18
SPACES = " \t\n\x0b\f\r"
DIGITS = 9


def words(text: Column) -> Column:
    """Lower-cased words between white space; an empty array for a null or blank text."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")).otherwise(F.array().cast("array<string>"))


def shingles(word: Column, k: int = SHINGLE) -> Column:
    """Hash of each k neighbouring words, in order; empty if there are fewer."""
    places = F.sequence(F.lit(0), F.greatest(F.size(word) - k, F.lit(0)))
    return F.when(F.size(word) >= k, F.transform(places, lambda i: F.xxhash64(*[F.get(word, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _total(own: Column) -> Column:
    return F.aggregate(own, F.lit(0.0), lambda s, e: s + e["weight"])


def _items(benchmark: DataFrame, threshold: float) -> DataFrame:
    """(item, item_id, k: words a shingle, length in shingles, own: distinct shingles with weights, heaviest first, most, lead) of each item that has words.

    A window that holds none of the ``lead`` first of ``own`` is below the threshold.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("word")).where(F.size("word") > 0).withColumn("k", F.least(F.size("word"), F.lit(SHINGLE)))
    whole = reduce(lambda out, k: F.when(F.col("k") == k, shingles(F.col("word"), k)).otherwise(out), range(1, SHINGLE), shingles(F.col("word")))
    items = items.select("item_id", "k", whole.alias("all")).distinct().withColumn("item", F.xxhash64("item_id", "k", "all"))
    total = float(items.count())
    each = items.select("item", F.explode(F.array_distinct("all")).alias("shingle"))
    weighed = each.join(each.groupBy("shingle").agg(F.count("*").alias("df")), "shingle")
    own = weighed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct(F.log1p(total / F.col("df")).alias("weight"), "shingle")), asc=False).alias("own"))
    own = own.withColumn("spare", _total(F.col("own")) * (1 - threshold + 10**-DIGITS))  # the weight that a window may miss, and room for rounding
    start = F.struct(F.lit(0.0).alias("before"), F.lit(0).alias("n"))
    lead = F.aggregate("own", start, lambda a, e: F.struct((a["before"] + e["weight"]).alias("before"), (a["n"] + (a["before"] <= F.col("spare")).cast("int")).alias("n")), lambda a: a["n"])
    return items.join(own, "item").select("item", "item_id", "k", F.size("all").alias("length"), "own", F.lit(math.log1p(total)).alias("most"), lead.alias("lead"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, set_bound: int = SET_BOUND) -> DataFrame:
    """(doc_id, row_key, item_id, similarity, start_word): documents with a passage like a benchmark item, best window of each item.

    Every window of an item's length is compared; a document shorter than the item
    is one window. An item of fewer than five words is one shingle of that many
    words, wherever it stands. Of equal similarities (to nine digits) the first
    window counts. A row of ``docs`` (doc_id, text) is known by ``row_key``, the hash
    of its id and text, so that ids may be null or repeated; rows equal in both are
    one, as are items equal in id and words. Null, empty and blank texts and items
    match nothing; other columns are ignored.
    """
    with Scratch(docs.sparkSession, "decontamination") as scratch:
        items = materialize(_items(benchmark, threshold), "items", scratch)
        kinds = {r["k"]: r["n"] for r in items.groupBy("k").agg(F.sum(F.size("own")).alias("n")).collect()}  # five rows at most
        parts = max(1, math.ceil(sum(kinds.values()) / set_bound))
        found = [_part(docs, items.where(F.pmod("item", F.lit(parts)) == p) if parts > 1 else items, sorted(kinds), threshold) for p in range(parts)]
        return materialize(reduce(DataFrame.unionByName, found), "contaminated")


def _part(docs: DataFrame, items: DataFrame, kinds: list[int], threshold: float) -> DataFrame:
    """``items`` have at most about ``set_bound`` shingles, which bounds both broadcasts."""
    lead = items.select("item", F.explode(F.slice("own.shingle", 1, F.col("lead"))).alias("shingle"))
    table = items.select("item", "item_id", "k", "length", "lead", "most", F.col("own.shingle").alias("own"), F.col("own.weight").alias("weight"))

    # An id that is always true is indeterminate to the optimizer, which would else compute the arrays once for each use.
    once = F.monotonically_increasing_id() >= 0
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.when(once, words(F.col("text"))).alias("word"))
    short = [k for k in kinds if k < SHINGLE]
    every = F.concat(shingles(F.col("word")), *[shingles(F.col("word"), k) for k in short])
    n = F.greatest(F.size("word") - (SHINGLE - 1), F.lit(0))
    rows = rows.select("doc_id", "row_key", n.alias("n"), F.size("word").alias("n_words"), F.when(once, every).alias("all"))
    # Exploding and joining run in one generated stage, so that an array is only copied where a lead stands.
    hits = rows.select("*", F.posexplode("all").alias("at", "shingle")).join(F.broadcast(lead), "shingle").join(F.broadcast(table), "item")
    first = F.greatest(F.col("at") - F.col("length") + 1, F.lit(0))
    around = F.when(F.col("k") == SHINGLE, F.slice("all", first + 1, F.least(F.col("n"), F.col("at") + F.col("length")) - first))
    hits = hits.select("doc_id", "row_key", "item_id", "k", "n", "n_words", "length", "lead", "most", "own", "weight", "at", first.alias("first"), F.when(once, around).alias("around"))

    # Places of the item's shingles by rank: 1 and up, 0 for others. A window counts at its first lead.
    hits = hits.withColumn("rank", F.when(once, F.transform("around", lambda x: F.array_position("own", x).cast("int"))))
    back = F.col("at") - F.col("first")
    earlier = F.array_max(F.transform(F.slice("rank", 1, back), lambda x, i: F.when((x > 0) & (x <= F.col("lead")), i + 1).otherwise(0)))
    low = F.col("first") + F.coalesce(earlier, F.lit(0))
    high = F.greatest(F.least(F.col("at"), F.col("n") - F.col("length")), F.lit(0))
    hits = hits.withColumn("starts", F.when(once & (F.col("k") == SHINGLE) & (low <= high), F.sequence(low, high)))
    whole = F.aggregate("weight", F.lit(0.0), lambda s, x: s + x)

    def compare(start: Column) -> Column:
        inside = F.slice("rank", start - F.col("first") + 1, F.col("length"))
        common = F.array_sort(F.array_distinct(F.filter(inside, lambda r: r > 0)))
        held = F.aggregate(common, F.lit(0.0), lambda s, r: s + F.get("weight", r - 1))
        other = F.size(F.array_distinct(F.slice("around", start - F.col("first") + 1, F.col("length")))) - F.size(common)
        return F.struct(F.round(held / (whole + F.col("most") * other), DIGITS).alias("similarity"), (-start).alias("back"))

    best = F.array_max(F.transform("starts", compare))
    # A short item is found where its one shingle stands; its start follows from the place in its part of the array.
    before = reduce(lambda out, k: out + F.when(F.col("k") > k, F.greatest(F.col("n_words") - (k - 1), F.lit(0))).otherwise(0), short, F.col("n"))
    same = F.struct(F.lit(1.0).alias("similarity"), (before - F.col("at")).alias("back"))
    pairs = hits.select("doc_id", "row_key", "item_id", F.when(F.col("k") == SHINGLE, best).otherwise(same).alias("best")).where(F.col("best.similarity") >= threshold)
    pairs = pairs.groupBy("doc_id", "row_key", "item_id").agg(F.max("best").alias("best"))
    return pairs.select("doc_id", "row_key", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start_word"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage like a benchmark item.

    Null, empty and blank texts stay; all columns pass, whatever their names. Rows
    equal in doc_id and text go or stay together.
    """
    key = unused(docs, "row_key")
    gone = contaminated(docs.select("doc_id", "text"), benchmark).select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(gone, key, "left_anti").select(docs.columns)
