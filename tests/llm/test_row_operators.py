"""Classifiers, tokenizers, archives and URL rules."""

import functools
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter as Counted
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import prose

from geolattice.llm import langid, toxicity
from geolattice.llm.boosting import Booster, Isotonic
from geolattice.llm.bytebpe import Codec, PrefixEncoder, Vocabulary, decode_documents, encode_documents, load_ranks, merge_all
from geolattice.llm.substring import remove_repeats
from geolattice.llm.tokencount import SPACE, Counter, UnigramVocabulary, count_tokens, read_vocabulary
from geolattice.llm.urlfilter import Model, Rule, filter_urls
from geolattice.llm.warc import fresh_folder, parse_records, read_archives, record, shard_bounds, write_archives

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = load_ranks(open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
TEXTS = st.text(st.one_of(st.sampled_from(list("abeht  \n\t'sS.!1é你😀\u00a0\u3000\x1c\x85")), st.characters(exclude_categories=["Cs"])), max_size=60)


# --- boosting ---------------------------------------------------------------------------------------------------------
def test_booster_learns_and_isotonic_orders():
    r = np.random.default_rng(0)
    x = r.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    score = Booster(rounds=30, leaves=8).fit(x, y).log_odds(x)
    assert ((score > 0) == y).mean() > 0.97
    p = Isotonic().fit(score, y.astype(float)).map(np.sort(score))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1
    assert np.isfinite(Booster().fit(x, np.ones(600, int)).log_odds(x)).all() and Booster().fit(x[:0], y[:0]).log_odds(x).shape == (600,)


def test_isotonic_is_the_least_squares_fit():
    r = np.random.default_rng(1)
    s, y = np.arange(12.0), r.random(12)
    fit = Isotonic().fit(s, y)
    best = [max(min(y[a : b + 1].mean() for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]
    steps = np.repeat(fit.value, [sum(np.isclose(b, v) for b in best) for v in fit.value])
    assert np.allclose(steps, best)


# --- language -----------------------------------------------------------------------------------------------------------
def test_ngrams_of_long_texts_by_pieces(monkeypatch):
    text = prose(1, 500)
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert (langid.ngram_counts(text) == whole).all() and langid.ngram_counts("").sum() > 0


def test_language_and_edges(spark, empty, docs):
    words = {"en": "the and of with that", "de": "und der die nicht schön", "es": "que los para niño"}
    rows = [(k, " ".join(random.Random(k).choices(words[lang].split(), k=12)), lang) for k in range(240) for lang in [list(words)[k % 3]]]
    table = spark.createDataFrame(rows + [(900, "und und", None), (901, None, "en"), (902, "123 !", "en")], "doc_id long, text string, lang string")
    model = langid.fit(table)
    got = {r["doc_id"]: r for r in langid.predict_languages(table, model).collect()}
    held = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 30 and all(got[k]["lang_pred"] == lang and 0 <= got[k]["score"] <= 1 for k, lang in held)
    assert got[900]["lang_pred"] == "de" and got[901]["lang_pred"] == got[902]["lang_pred"] == "und"
    assert (model.weights == 0).mean() > 0.5  # the penalty keeps weights sparse
    assert langid.predict_languages(empty, langid.fit(empty)).count() == 0
    out = langid.predict_languages(docs, langid.fit(docs))
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)


# --- toxicity -------------------------------------------------------------------------------------------------------------
def test_toxicity_by_held_out_rows(spark, docs, empty):
    rows, labels = [], []
    for k in range(400):
        r, bad = random.Random(k), k % 5 == 0
        words = prose(k, 60).split(" ")
        for _ in range(5 if bad else 0):
            words.insert(r.randrange(len(words)), "you " + r.choice(["idi0t", "Moron", "trash"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1 if bad else 0))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(table, toxicity.fit(table, marks)).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    model = toxicity.fit(docs, marks)
    got = toxicity.score_documents(docs, model)
    assert got.count() == docs.count() and set(docs.columns) <= set(got.columns)
    assert toxicity.score_documents(empty, toxicity.fit(empty, marks.limit(0))).count() == 0
    assert toxicity.keep_clean(docs, marks).columns == docs.columns


def test_toxicity_without_labels_of_both_kinds_keeps_all(spark, docs):
    for rows in ([], [(k, 1) for k in range(60)], [(k, 0) for k in range(60)], [(1, None), (None, 1)]):
        marks = spark.createDataFrame(rows, "doc_id long, toxic int")
        out = toxicity.score_documents(docs, toxicity.fit(docs, marks))
        assert {(r["score"], r["predicted"]) for r in out.select("score", "predicted").distinct().collect()} == {(0.0, 0)}
        assert toxicity.keep_clean(docs, marks).count() == docs.count()


def test_no_column_of_the_caller_is_lost(spark):
    """Names that differ from those of results in case only, and those that operators use themselves."""
    rows = [(k, prose(k, 60), 7, "own", "mine") for k in range(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, Score int, Predicted string, _geolattice_row string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    kept = toxicity.keep_clean(table, marks)
    assert kept.columns == table.columns and set(kept.collect()) <= set(table.collect())
    out = remove_repeats(table)
    assert out.columns[:5] == table.columns and {r["_geolattice_row"] for r in out.collect()} == {"mine"}
    scored = toxicity.score_documents(table, toxicity.fit(table, marks))
    assert scored.columns == ["doc_id", "text", "_geolattice_row", "score", "predicted"]
    assert langid.predict_languages(table, langid.Model()).columns == ["doc_id", "text", "Predicted", "_geolattice_row", "lang_pred", "score"]


def plain_features(text, strong, weak):
    """The features of one text of ASCII words, by definition."""
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9@$*]+", text)]
    fold = lambda w: w.lower().translate(str.maketrans(toxicity.LOOKALIKES))
    letters, n, size = max(1, sum(c.isalpha() for c in text)), max(1, len(words)), max(1, len(text))
    hit = [fold(w) in strong for w, _, _ in words]
    person = [k for k, (w, _, _) in enumerate(words) if fold(w) in {fold(p) for p in toxicity.SECOND_PERSON}]
    near = sum(h and any(abs(k - p) <= toxicity.NEAR for p in person) for k, h in enumerate(hit))
    folded = fold(text)
    single = [len(w) == 1 and w.isalpha() for w, _, _ in words]
    close = [k > 0 and single[k] and single[k - 1] and words[k][1] - words[k - 1][2] == 1 for k in range(len(words))]
    stands = "0123456789@$*"
    return [
        sum(hit) / n, sum(hit), len({fold(w) for (w, _, _), h in zip(words, hit) if h}), sum(fold(w) in weak for w, _, _ in words) / n, near / n, near,
        sum(c.isupper() for c in text) / letters,
        sum(len(w) >= 3 and sum(c.isupper() for c in w) >= len(w) - (len(w) > 3) for w, _, _ in words) / n,
        text.count("!") / size, text.count("?") / size,
        sum(not (c.isalpha() or c in stands or c in " \t\n\v\f\r") for c in text) / size,
        sum(text[k - 1].isalpha() and text[k] in stands and text[k + 1].isalpha() for k in range(1, len(text) - 1)) / n,
        sum(text[k].isalpha() and folded[k] == folded[k - 1] == folded[k - 2] for k in range(2, len(text))) / n,
        sum(close[k] and close[k - 1] and close[k - 2] for k in range(3, len(words))) / n,
        sum(c.isdigit() for c in text) / size, np.log1p(n),
    ]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(list("abIDOTyou  .!?$014\n"), max_size=60), min_size=1, max_size=4))
def test_toxicity_features_equal_plain_ones(texts):
    strong, weak = ["idiot", "tot", "dodo"], ["you", "a", "bot"]
    model = toxicity.Model(toxicity.hash_words(strong), toxicity.hash_words(weak))
    fold = lambda w: w.lower().translate(str.maketrans(toxicity.LOOKALIKES))
    got = np.concatenate([model.features(m) for m in toxicity._all_marks(pa.array(texts))])
    assert np.allclose(got, [plain_features(t, set(map(fold, strong)), set(map(fold, weak))) for t in texts])


def test_language_of_few_rows_is_learned():
    assert langid.shares({"en": 10**6, "de": 1000, "xx": 3}, 400) == {"en": 66 + 264, "de": 66, "xx": 3}
    assert langid.shares({"en": 5}, 400) == {"en": 5}


def test_language_vector_equals_plain_counts():
    text = "Ab a😀é"
    counts = langid.ngram_counts(text)
    padded = [ord(c) for c in " " + text.lower() + " "]
    hashed = lambda *x: (functools.reduce(lambda h, y: y[0] if h is None else (h * y[1] + y[0]) % 2**32, zip(x, (0, 0x85EBCA6B, 0xC2B2AE35)), None) * 0x9E3779B1 % 2**32) >> (32 - langid.BITS)
    plain = Counted(hashed(*padded[k : k + n]) for n in (1, 2, 3) for k in range(len(padded) - n + 1))
    assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == plain
    idf = np.linspace(1, 2, 1 << langid.BITS)
    model = langid.Model(["de", "en"], idf, np.random.default_rng(1).standard_normal((1 << langid.BITS, 2)), np.array([0.1, -0.1]), 0.7)
    x = {k: math.log1p(n) * idf[k] for k, n in plain.items()}
    length = math.sqrt(sum(v * v for v in x.values()))
    z = [(sum(v / length * model.weights[k][c] for k, v in x.items()) + model.bias[c]) / 0.7 for c in range(2)]
    want = math.exp(max(z)) / sum(map(math.exp, z))
    lang, score = model.predict(text)
    assert lang == ["de", "en"][int(z[1] > z[0])] and abs(score - want) < 1e-9


def test_lookalikes_and_case_share_a_hash():
    assert len(toxicity.hash_words(["Idiot", "1d1ot", "IDI0T"])) == 1
    assert len(toxicity.hash_words(["É", "é"])) == 1


# --- byte-level BPE ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


CODEC = Codec(RANKS, tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_bpe_equals_library(library, text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(piece=st.binary(max_size=80).map(lambda b: bytes(c % 3 + 97 for c in b)), at=st.integers(0, 80), gone=st.integers(0, 6), new=st.binary(max_size=5), more=st.binary(max_size=9))
def test_appends_and_edits_are_exact(piece, at, gone, new, more):
    v = CODEC.vocabulary
    encoder = PrefixEncoder(v, piece)
    encoder.append(more)
    at = min(at, len(encoder.piece))
    encoder.replace(at, min(len(encoder.piece), at + gone), new)
    assert encoder.tokens() == v.encode(encoder.piece) == [RANKS[t] for t in merge_all(encoder.piece, RANKS)]


def test_edit_encodes_only_its_surroundings():
    encoder = PrefixEncoder(Vocabulary(RANKS), prose(5, 2000).encode())
    assert encoder.replace(100, 103, b"xyz") < 1000
    assert encoder.tokens() == CODEC.vocabulary.encode(encoder.piece)


def test_bpe_documents(docs, empty, library):
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    got = encode_documents(docs, path, tokenizers.PATTERN, digests=True).collect()
    want = sorted((hashlib.sha256(np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    back = decode_documents(encode_documents(docs, path, tokenizers.PATTERN), path)
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())
    assert encode_documents(empty, path, tokenizers.PATTERN).count() == 0


# --- unigram counts -----------------------------------------------------------------------------------------------------------
def brute(vocabulary, text):
    """Viterbi over all substrings."""
    pieces, lowest = dict(vocabulary.pieces), min(s for _, s in vocabulary.pieces) - 10
    best, n = [0.0] + [-np.inf] * len(text), [0] * (len(text) + 1)
    for e in range(1, len(text) + 1):
        for s in range(e):
            t = text[s:e]
            options = [(pieces[t], 1)] if t in pieces else []
            if e - s == 1 and t not in pieces:
                options.append((lowest, len(t.encode())))
            for score, k in options:
                if best[s] + score > best[e]:
                    best[e], n[e] = best[s] + score, n[s] + k
    return n[-1], best[-1]


@settings(max_examples=200, deadline=None)
@given(text=st.text("ab▁cé", max_size=14))
def test_counts_with_ties_equal_brute_force(text):
    v = UnigramVocabulary((("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), (SPACE, -1.0), (SPACE + "a", -2.0), (SPACE + "ab", -2.5)))
    score, number = Counter(v).solve(text)
    assert (number, score) == brute(v, text)


@settings(max_examples=100, deadline=None)
@given(text=st.text("ab cé", max_size=14))
def test_scores_that_are_no_whole_numbers(text):
    """Whole texts are solved then, and counts and scores are those of one running sum."""
    v = UnigramVocabulary((("a", -0.1), ("b", -0.2), ("ab", -0.3), (SPACE, -0.7), (SPACE + "a", -0.8), ("c", -1.1)))
    assert Counter(v).words is None
    assert Counter(v).count(text) == (brute(v, SPACE + text.replace(" ", SPACE)) if text else (0, 0.0))


def test_counts_equal_library():
    lib = pytest.importorskip("tokenizers")
    v = read_vocabulary(tokenizers.path("piece_bpe_32k.model"))
    pieces = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *v.pieces]
    model, own = lib.Tokenizer(lib.models.Unigram(pieces, 0, byte_fallback=True)), Counter(v)
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("abcdehinorst  éß日😀\n.") for _ in range(r.randrange(1, 80)))
        assert own.count(text)[0] == len(model.encode(SPACE + text.replace(" ", SPACE), add_special_tokens=False).ids)


def test_count_documents(docs, empty):
    v = read_vocabulary(tokenizers.path("piece_bpe_32k.model"))
    own = Counter(v)
    assert all(r["n_tokens"] == own.count(r["text"])[0] for r in count_tokens(docs, v).collect())
    assert count_tokens(empty, v).count() == 0


# --- archives ------------------------------------------------------------------------------------------------------------------
def test_record_round_trip():
    data = record(5, "http://a/\r\nb", "é".encode() * 3, None, "1970-01-01T00:00:00Z")
    (headers, block), = parse_records(iter([gzip.compress(data)]))
    assert block.endswith("ééé".encode()) and headers["X-Page-ID"] == "5" and "%0D%0A" in headers["WARC-Target-URI"]
    with pytest.raises(ValueError):
        list(parse_records(iter([gzip.compress(data.replace("é".encode(), b"xx", 1))])))


def test_archives(spark, tmp_path):
    long, other = "<p>" + "x" * 1500, "<p>é" + "y" * 1500
    rows = [(1, "http://a/1", long, "z"), (2, "http://a/2", long, "z"), (9, None, long, "z"), (3, "http://b", "short", "z"), (4, "http://c", "short", "z"), (5, "u", None, "z"), (6, "u", "", None), (7, "u", other, "z"), (8, "u", other, "z"), (8, "u", other, "z"), (None, "u", long, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    folder = f"file://{tmp_path}/one"
    manifest = write_archives(pages, folder, shards=3, roll_bytes=300)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and manifest.count() > 3
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in read_archives(spark, folder).collect()]
    sha = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    want = [(i, *{1: ("revisit", 9), 2: ("revisit", 9), 7: ("revisit", 8)}.get(i, ("response", None)), len((h or "").encode()), sha(h)) for i, _, h, _ in rows]
    want[want.index((8, "response", None, 1505, sha(other)))] = (8, "revisit", 8, 1505, sha(other))
    assert sorted(map(str, got)) == sorted(map(str, want))
    write_archives(pages.repartition(5), f"file://{tmp_path}/two", shards=3, roll_bytes=300)
    again = spark.read.parquet(f"file://{tmp_path}/two/manifest")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))  # the same bytes
    nothing = fresh_folder(spark)
    write_archives(pages.limit(0), nothing)
    assert read_archives(spark, nothing).count() == 0


def test_archives_of_many_rows_are_the_same_each_time(spark):
    """More rows than a sampled range sort would take as they are, dealt anew each time."""
    pages = spark.range(60_000).selectExpr("id * id - 1000 AS page_id", "'http://a/' || id AS url", "repeat(string(id % 50), 20) AS html")
    made = []
    for parts in (3, 7):
        folder = fresh_folder(spark)
        made.append(sorted(map(tuple, write_archives(pages.repartition(parts), folder, shards=4).collect())))
    assert made[0] == made[1] and max(r[1] for r in made[0]) < 18_000


def test_record_ids_are_unique_for_repeated_rows(spark):
    long = "<p>" + "x" * 1500
    rows = [(1, "u", long), (1, "u", long), (1, "v", long), (2, "u", long), (2, "u", long), (None, "u", long), (None, "u", long), (None, "v", long), (3, "u", "s"), (3, "u", "s"), (None, None, None), (None, None, None)]
    folder = fresh_folder(spark)
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, shards=2)
    found = []
    for name in Path(folder.removeprefix("file:")).glob("*.warc.gz"):
        found += [h for h, _ in parse_records(iter([name.read_bytes()]))]
    ids = {h["WARC-Record-ID"]: h for h in found}
    assert len(ids) == len(found) == len(rows)
    assert all(ids[h["WARC-Refers-To"]]["WARC-Type"] == "response" and ids[h["WARC-Refers-To"]]["X-Page-ID"] == "2" for h in found if h["WARC-Type"] == "revisit")


@pytest.mark.parametrize("ids", [[0], [5] * 100, list(range(1000)), list(range(20_000)), [-(2**63), 2**63 - 1, *range(100)], [k**9 for k in range(128)], [], [None, 3]])
def test_shard_bounds_are_even(spark, ids):
    bounds = shard_bounds(spark.createDataFrame([(i,) for i in ids], "id long"), 8)
    assert bounds == sorted(set(bounds)) and len(bounds) < 8
    known = [i for i in ids if i is not None]
    counts = np.bincount(np.searchsorted(bounds, known, "right")) if known else np.zeros(1)
    assert counts.max() <= max(len(known) / 8 * 1.3 + 1, max(Counted(known).values(), default=0))


# --- urls ------------------------------------------------------------------------------------------------------------------------
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def judged(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1?x=/y#z", "https://example.org/en/12", "http://notexample.org/es/", "http://x.com/de/", "http://x.com/DE/", "ftp://com/fr/é", "http://ÀB.net?q#/de/", "http://net#a/b", "nothing", "", None, "http://", "a://b://c/d", "http://x.org", "http://h\n/p", "x" * 5000]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls * 3)], "page_id long, url string, host string")
    for r in filter_urls(pages, RULES).collect():
        host, path, rule, verdict = judged(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1
    assert filter_urls(pages.limit(0), RULES).count() == 0


def test_url_trees_learn_from_labels(spark):
    rows = [(f"http://{'win-casino' if k % 2 else 'news'}{k % 7}.test/{k}?a=1", "block" if k % 2 else "allow") for k in range(300)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    fresh = spark.createDataFrame([(1, "http://win-casino99.test/5000?a=1"), (2, "http://news99.test/5001?a=1")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in filter_urls(fresh, [], labelled).collect()} == {1: "block", 2: "allow"}


@pytest.mark.parametrize("verdict", [None, "block", "allow"])
def test_urls_without_labels_of_both_kinds_are_allowed(spark, verdict):
    pages = spark.createDataFrame([(k, f"http://h{k}.net/{k}", "x") for k in range(30)], "page_id long, url string, VERDICT string")
    labelled = spark.createDataFrame([(f"http://h{k}.net/", verdict) for k in range(30) if verdict], "url string, verdict string")
    got = filter_urls(pages, [], labelled).collect() if verdict else filter_urls(pages, [Rule("block", "org", "/")]).collect()
    assert {(r["verdict"], r["score"]) for r in got} == {("allow", 0.0)} and len(got) == 30


def test_url_features_equal_plain_ones():
    url = "https://a-b.c9.example.org/x/yy//zzz/?q=1&&r=22#f"
    entropy = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counted(t).values())
    got = Model(share=0.25).features(url, "a-b.c9.example.org", "/x/yy//zzz/", [10, 3, 4, 4, 0, 0], own=1)
    assert np.allclose(got, [len(url), 18, 11, 3, 3, 1, 4 / len(url), 1 / 18, entropy(url), entropy("a-b.c9.example.org"), 2, 9, 1, 1, 3, (2 + 1) / 13, (3 + 1) / 7, 1 / 4])
