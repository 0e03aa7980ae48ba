"""Vector near-dedup against brute force, components, the pipeline's stages, and skew."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from samples import SCHEMA, prose
from test_word_operators import components, cut, shingles

from geolattice.llm import vectordedup
from geolattice.llm.components import connected_components
from geolattice.llm.vectordedup import near_duplicates
from geolattice.operators import graph

VECTORS = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows):
    """Links of distinct ids by cosine within labels."""
    usable = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab, _ in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    parent, n = {r[0]: r[0] for r in rows if r[0] is not None}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x, p) in enumerate(usable):
        for j, y, q in usable[:a]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                n[i] += 1
                n[j] += 1
                s, t = find(i), find(j)
                parent[max(s, t)] = min(s, t)
    return n, {i: find(i) for i in parent}


def cloud(n, groups, seed=3, dims=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((groups, dims))
    return [(int(k), (base[k % groups] + 0.12 * r.standard_normal(dims)).tolist(), int(k % groups % 3), "x") for k in range(n)]


ODD = [(1000, None, 1, "x"), (1001, [0.0] * 16, 1, "x"), (1002, [1.0, None] * 8, 1, "x"), (1003, [float("nan")] * 16, 1, "x"), (1004, [float("inf")] * 16, 1, "x"), (1005, [1.0] * 16, None, "x"), (1006, [1.0] * 16, 1, "x"), (1007, [2.0] * 16, 1, "x"), (1008, [1.0] * 16, 1, "x"), (1009, [1.0] * 8, 1, "x"), (1010, [], 1, "x"), (1011, [1.0] * 16, 2, "x"), (1012, [1e-30] * 16, 1, "x")]


@pytest.mark.parametrize("cell, block", [(2048, 1024), (40, 16)])
def test_vectors_equal_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vectordedup, "CELL", cell)
    monkeypatch.setattr(vectordedup, "BLOCK", block)
    monkeypatch.setattr(vectordedup, "SLACK", 2.0)  # all cells: exact
    rows = cloud(300, 25) + ODD
    got = {r["vec_id"]: r for r in near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    n, names = brute(rows)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (n[i], names[i], names[i] == i)


def test_recall_of_cells(spark, monkeypatch):
    monkeypatch.setattr(vectordedup, "CELL", 60)
    rows = [(i, v, 0, "x") for i, v, _, _ in cloud(900, 300, dims=32)]
    got = near_duplicates(spark.createDataFrame(rows, VECTORS)).agg({"n_links": "sum"}).first()[0]
    assert 0.9 <= got / sum(brute(rows)[0].values()) <= 1


def test_vectors_without_rows_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x")]
    got = sorted(map(str, (tuple(r) for r in near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())))
    assert got == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]))


@pytest.mark.parametrize("finish", [50_000, 0, 30])
def test_components_of_chains_and_stars(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH", finish)
    r = random.Random(4)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 200)] + [(300, 300), (None, 5), (7, 8), (8, 7)]
    r.shuffle(pairs)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 200)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------------
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    top = tmp_path_factory.mktemp("sf")
    rows = []
    for k in range(200):
        words = prose(k, 50).split(" ")
        if k % 4 == 0:
            for at in (3, 11, 19, 30):
                words.insert(at, "you moron idiot trash")
        rows.append((5000 + k, " ".join(words), "en", "s", 1, None, None, None))
    item = prose(12345, 40)
    rows += [(7000, f"{prose(7000, 30)} {item} {prose(7001, 30)}", "en", "s", 1, None, None, None)]
    docs.unionByName(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("moron" in r[1])) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return f"file://{top}"


def test_stages(spark, folder):
    stages = dict(pipeline.STAGES)
    assert list(stages) == [n for n, _ in pipeline.STAGES] and len(stages) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    read = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    step = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        step[name] = (read(docs), out)
        if name != "byte_bpe":
            assert out.columns == list(pipeline.COLUMNS)
            out.write.parquet(f"{folder}/out-{name}")
            docs = spark.read.parquet(f"{folder}/out-{name}")
    before, out = step["toxicity"]
    assert {i for i, t in before} - {i for i, _ in read(out)} == {i for i, t in before if t and "moron" in t}
    before, out = step["near_copies"]
    ids = [i for i, _ in before if i is not None]
    names = components(ids, [shingles(t) for i, t in before if i is not None])
    assert Counter(i for i, _ in read(out)) == Counter(i for i, _ in before if i is None or names[i] == i)
    before, out = step["repeated_passages"]
    assert Counter(read(out)) == Counter((i, t if not r else k) for (i, t), (_, r, k) in zip(before, cut([t for _, t in before])))
    before, out = step["decontamination"]
    assert {i for i, _ in before} - {i for i, _ in read(out)} == {7000}
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: np.array(library.encode_ordinary(t or ""), "<u4") for i, t in step["byte_bpe"][0] if i is not None}
    got = [r for r in step["byte_bpe"][1].collect() if r["doc_id"] is not None]
    assert len(got) == sum(i is not None for i, _ in step["byte_bpe"][0])
    texts = dict(step["byte_bpe"][0])
    for r in got:
        if Counter(i for i, _ in step["byte_bpe"][0])[r["doc_id"]] == 1:
            own = ids[r["doc_id"]]
            assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(own.tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert sorted(map(str, pipeline.run(spark, folder).collect())) == sorted(map(str, step["byte_bpe"][1].collect()))


def test_stages_on_empty_tables_and_other_columns(spark, folder):
    nothing = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
