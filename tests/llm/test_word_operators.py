"""Substring dedup, Jaccard join and decontamination against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from samples import prose

from geolattice.llm import jaccard, substring
from geolattice.llm.decontaminate import contaminated, keep_uncontaminated
from geolattice.llm.jaccard import keep_one_of_each, similar_documents
from geolattice.llm.substring import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def cut(rows, window=35):
    words = [WORD.findall(t or "") for t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, sets):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_substring_equals_brute_force(docs):
    rows = docs.collect()
    expected = Counter(zip((r["doc_id"] for r in rows), cut([r["text"] for r in rows])))
    out = remove_repeats(docs)
    assert set(docs.columns) <= set(out.columns)
    got = Counter((r["doc_id"], (r["n_words"], r["n_removed"], r["kept"])) for r in out.collect())
    assert got == expected
    assert {r["row_key"] for r in out.select("row_key").distinct().collect()} == {"mine", "k", None}


@pytest.mark.parametrize("filter_bits, group_words", [(9, 1 << 16), (None, 40), (9, 1)])
def test_substring_small_window_full_filter_and_long_prefixes(docs, filter_bits, group_words):
    rows = docs.where("doc_id < 70").collect()
    expected = Counter(zip((r["doc_id"] for r in rows), cut([r["text"] for r in rows], 12)))
    out = remove_repeats(docs.where("doc_id < 70").select("doc_id", "text"), window=12, prefix=3, filter_bits=filter_bits, group_words=group_words)
    assert Counter((r["doc_id"], (r["n_words"], r["n_removed"], r["kept"])) for r in out.collect()) == expected


@pytest.mark.parametrize("group_words", [1 << 16, 300, 20])
def test_substring_of_few_different_words(spark, group_words):
    """Words from a small vocabulary, so that prefixes of all lengths repeat within and across texts and anchors tie."""
    r = random.Random(5)
    texts = [" ".join(r.choices("abc", weights=(8, 1, 1), k=r.randrange(60))) for _ in range(150)] + ["a " * 100, "a b " * 40, "c"]
    expected = Counter(zip(range(len(texts)), cut(texts, 9)))
    out = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), window=9, prefix=2, group_words=group_words)
    assert Counter((x["doc_id"], (x["n_words"], x["n_removed"], x["kept"])) for x in out.collect()) == expected


def test_groups_of_a_common_passage_are_divided(spark):
    """One passage in every text among other words: no group keeps more than it may, and the result is that of whole groups."""
    passage = prose(1, 60)
    texts = [f"{prose(k, 20)} {passage} {prose(1000 + k, 20)}" for k in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for group_words in (1 << 20, 2000):
        got = remove_repeats(table, group_words=group_words).select("doc_id", "n_removed", "kept")
        assert sorted(map(tuple, got.collect())) == [(k, n, t) for k, (_, n, t) in enumerate(cut(texts))]
        keyed = table.select(F.col("doc_id").alias("_geolattice_row"), "text")
        _, large = substring._count(keyed, 35, 8, substring.Sizes.of(table, None), group_words, None)
        assert (large > 0) == (group_words == 2000)


@pytest.mark.parametrize("short, block_tokens, block_rows", [(6, 1 << 16, 512), (2, 200, 2)])
def test_jaccard_equals_brute_force(docs, monkeypatch, short, block_tokens, block_rows):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block_tokens)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block_rows)
    rows = docs.where("doc_id is not null").collect()
    expected = components([r["doc_id"] for r in rows], [shingles(r["text"]) for r in rows])
    got = similar_documents(docs).collect()
    assert len(got) == docs.count()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((r["doc_id"], len(shingles(r["text"]))) for r in docs.collect())
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_jaccard_takes_what_many_prefixes_hold_out_of_them(spark):
    """Passages of ten texts, which no slice of rows holds twice, must not chain the texts."""
    rows = [(10 * p + d, " ".join(f"p{p}w{k}" for k in range(5)) + f" a{p}x{d} b{p}x{d} c{p}x{d}") for p in range(30) for d in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(10, F.col("doc_id") % 10)
    few = jaccard.frequent_tokens(docs)
    token = jaccard.crowded_tokens(docs, few)
    assert len(few) == 0 and len(token) > 0
    assert len(jaccard.crowded_tokens(docs, token)) == len(token) == len(set(token.tolist()))
    assert len(jaccard.crowded_tokens(docs, few, most=3)) == 3


def test_jaccard_stage_keeps_one(docs):
    one = docs.where("doc_id between 0 and 59").dropDuplicates(["doc_id"])
    kept = keep_one_of_each(one)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {3, 5} <= ids and not ids & set(range(40, 60)) and set(range(40)) <= ids


@pytest.fixture(scope="module")
def benchmark_items(spark):
    items = [(0, prose(1000, 40)), (1, prose(1001, 25)), (2, "too few words"), (3, ""), (4, None), (5, prose(1000, 40))]
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_finds_items_and_near_ones(spark, benchmark_items):
    item, other = prose(1000, 40), prose(1001, 25)
    edited = item.split(" ")
    edited[1] = "changed"
    half = " ".join(item.split(" ")[:18])
    texts = [f"{prose(1, 50)} {item.upper()} {prose(2, 30)}", other, f"{prose(3, 20)}\n{' '.join(edited)}\t{prose(4, 9)}", f"{prose(5, 40)} {half} {prose(6, 40)}", prose(7, 100), None, "", "Too few WORDS", "x " * 3000, f"{other} {item}"]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(0, texts[0], 2), (None, item, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int")
    for bound in (1 << 16, 30):
        got = contaminated(docs.select("doc_id", "text"), benchmark_items, set_bound=bound)
        found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
        assert found == {(0, 0), (0, 5), (1, 1), (2, 0), (2, 5), (7, 2), (9, 0), (9, 1), (9, 5), (None, 0), (None, 5)}
    kept = keep_uncontaminated(docs, benchmark_items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 8}
    assert "Python" not in got._jdf.queryExecution().toString()


def test_empty_tables(docs, empty, benchmark_items):
    assert remove_repeats(empty).count() == 0
    assert similar_documents(empty).count() == 0
    assert contaminated(empty, benchmark_items).count() == 0
    assert keep_uncontaminated(docs, benchmark_items.limit(0)).count() == docs.count()
    assert keep_one_of_each(empty).columns == empty.columns
