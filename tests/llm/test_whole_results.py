"""Results near limits, where less than the whole job would show."""

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import prose

from geolattice.llm.decontaminate import contaminated, keep_uncontaminated
from geolattice.llm.queries import ORACLE_SQL
from geolattice.llm.urlfilter import filter_urls


def test_decontamination_equals_its_sql_near_the_threshold(spark):
    """Items that share a template, copies of them with a few words changed: similarities around 0.75, where a bounded search radius loses some and windows of another length match too many."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(7)
    template = prose(2000, 14).split(" ")
    items = {k: template + prose(2001 + k, 20 + k % 3 * 5, 10**6).split(" ") for k in range(40)}
    texts = []
    for k, item in items.items():
        for _ in range(25):
            w = list(item)
            at = r.randrange(len(w))
            for p in range(at, min(len(w), at + r.choice((1, 1, 2, 4)))):
                w[p] = f"new{r.randrange(10**6)}"
            if r.random() < 0.2:
                w.insert(r.randrange(len(w)), "more")
            texts.append(" ".join([*prose(r.randrange(10**6), 9).split(" ")[: r.randrange(9)], *w, *prose(r.randrange(10**6), 9).split(" ")[: r.randrange(9)]]))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    benchmark = pd.DataFrame({"item_id": list(items), "text": [" ".join(w) for w in items.values()]})
    with duckdb.connect() as con:
        con.register("documents", documents)
        con.register("benchmark", benchmark)
        expected = {tuple(x) for x in con.execute(ORACLE_SQL["op1_decontamination"]).fetchall()}
    got = contaminated(spark.createDataFrame(documents), spark.createDataFrame(benchmark))
    found = {(x["doc_id"], x["item_id"], round(x["similarity"], 6), x["start_word"]) for x in got.collect()}
    assert sum(x[2] < 0.8 for x in expected) > 100
    assert {x[:2] for x in found} == {x[:2] for x in expected}
    assert {(a, b, d) for a, b, _, d in found} == {(a, b, d) for a, b, _, d in expected}
    similarity = {(a, b): s for a, b, s, _ in expected}
    assert all(abs(similarity[a, b] - s) < 2e-6 for a, b, s, _ in found)


def test_url_statistics_count_labels_beyond_the_sample(spark):
    """Hosts told apart by their labels alone, more of them than the sample holds."""
    r = random.Random(3)
    blocked = {f"h{r.randrange(10**5, 10**6)}.test": k % 2 > 0 for k in range(1000)}
    rows = [(f"http://{h}/{r.randrange(1000, 10000)}", "block" if bad else "allow") for h, bad in blocked.items() for _ in range(3)]
    fresh = spark.createDataFrame([(f"http://{h}/{r.randrange(1000, 10000)}",) for h in blocked], "url string")
    got = filter_urls(fresh, [], spark.createDataFrame(rows, "url string, verdict string"), sample=300).collect()
    assert len(got) == len(blocked)
    assert sum((x["verdict"] == "block") == blocked[x["host"]] for x in got) > 0.98 * len(got)


def test_decontamination_finds_copies_with_far_fingerprints(spark):
    """One word of forty changed, similarity 0.756, SimHash 20 or 21 bits away."""
    item = prose(3000, 40, 10**6)
    texts = []
    for k, at in ((170, 20), (1734, 24), (3346, 16), (7321, 11)):
        w = item.split(" ")
        w[at] = f"new{k}"
        texts.append((k, " ".join(w)))
    got = contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((x["doc_id"], round(x["similarity"], 6)) for x in got.collect()) == [(k, 0.756098) for k, _ in texts]


def brute_windows(texts, items, threshold=0.75):
    """Best window of each text and item over all starts, by definition."""
    items = {i: t.lower().split() for i, t in items.items() if t and t.split()}
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    own = {i: set(grams(w, min(5, len(w)))) for i, w in items.items()}
    df = Counter(g for s in own.values() for g in s)
    weight = lambda g: math.log1p(len(own) / df[g]) if g in df else math.log1p(len(own))
    out = {}
    for d, text in texts.items():
        for i, item in items.items():
            k, n = min(5, len(item)), len(item) - min(5, len(item)) + 1
            have = grams((text or "").lower().split(), k)
            for s in range(max(1, len(have) - n + 1)):
                window = set(have[s : s + n])
                if window & own[i]:
                    x = round(sum(map(weight, window & own[i])) / (sum(map(weight, own[i])) + math.log1p(len(own)) * len(window - own[i])), 9)
                    if x >= threshold and x > out.get((d, i), (0, 0))[0]:
                        out[d, i] = (x, s)
    return out


def test_decontamination_equals_brute_force_over_all_starts(spark):
    """Texts of few words with many partial repeats, short items, words put in, and texts shorter than an item."""
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(30)]
    items = {k: " ".join(r.choices(vocabulary, k=r.choice((6, 9, 14, 20)))) for k in range(12)}
    items |= {20: "too few words", 21: "w1", 22: "w2 w3 w4 w5", 23: items[3], 24: "", 25: None, 26: "one two three four five six"}
    texts = {}
    for k in range(250):
        w = (items[r.randrange(12)]).split()
        for _ in range(r.randrange(4)):
            at = r.randrange(len(w))
            w[at : at + r.randrange(2)] = r.choices(vocabulary, k=r.randrange(3))
            w = w or ["w0"]
        texts[k] = " ".join([*r.choices(vocabulary, k=r.randrange(5)), *w, *r.choices(vocabulary, k=r.randrange(5)), *(w if k % 9 == 0 else [])])
    texts |= {300: None, 301: "", 302: "too few words in a longer text TOO few words", 303: "w1", 304: "zzz two three four five six", 305: "one two three four five", 306: "w2 w3 w4 w5 " * 300}
    got = contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    found = {(x["doc_id"], x["item_id"]): (x["similarity"], x["start_word"]) for x in got.collect()}
    expected = brute_windows(texts, items)
    assert found.keys() == expected.keys() and len(found) > 150
    assert all(abs(found[k][0] - expected[k][0]) < 2e-9 for k in found)
    assert sum(found[k][1] != expected[k][1] for k in found) <= 2  # similarities that differ in the last digit only


def test_decontamination_finds_windows_that_stand_nowhere_aligned(spark):
    """Words put into a copy between a shared head and tail: only a window that starts inside reaches the threshold."""
    head, tail = prose(50, 6, 10**6), prose(51, 6, 10**6)
    middles = {k: prose(100 + k, 38, 10**6).split(" ") for k in range(300)}
    items = {k: f"{head} {' '.join(m)} {tail}" for k, m in middles.items()}
    m = middles[7]
    texts = {1: f"{head} {' '.join(m[:15])} four new words here {' '.join(m[15:])} {tail}", 2: items[9], 3: f"{head} {tail}"}
    expected = brute_windows(texts, items)
    assert expected[1, 7][1] == 2
    docs = spark.createDataFrame([*texts.items(), (2, items[9])], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert sorted((x["doc_id"], x["item_id"], x["start_word"]) for x in got.collect()) == sorted((*k, s) for k, (_, s) in expected.items())  # equal rows are one
    assert keep_uncontaminated(docs.withColumn("ROW_KEY", F.lit(1)), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect() == [(3, texts[3], 1)]
