"""The registered queries over the driver's tables, one an operator, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import remove
from .session import materialize, prepare
from .urlfilter import Rule

#: The production rules of the URL filter.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents like items of the benchmark: the best window of each pair.

    Null, empty and blank texts match nothing; rows equal in id and text are one; of equal
    windows the first counts. Only doc_id and text are read.
    """
    from .decontaminate import contaminated

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start_word")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document. ``und`` and 0 for a null text, one without letters, or if nothing could be learned.

    Repeated rows are judged alike. lang, source and doc_id are no inputs of a prediction.
    """
    from .langid import HELD_OUT, fit, predict_languages

    docs = _table(spark, sf_dir, "documents")
    out = predict_languages(docs.select("doc_id", "text"), fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document; 0 for all if labels of both kinds are lacking.

    Null and empty texts are judged as texts without words, repeated rows alike.
    """
    from .toxicity import fit, score_documents

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, fit(docs, _table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, encoded and decoded. A null text is empty and has none; repeated rows are encoded alike."""
    import public_tokenizers

    from .bytebpe import encode_documents

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within labels. Vectors or labels that can't be compared link with nothing.

    Rows repeated in id, label and vector count as one vector and are all returned; of a
    group the smallest id is kept.
    """
    from .vectordedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies. Null, empty and blank texts have no shingles and are alone.

    Rows repeated in id and text are returned as often; texts of one id are joined.
    """
    from .jaccard import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that start anywhere else, too. A null text has no words.

    A repeated row is another document: all of its windows repeat.
    """
    from .substring import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back. A null html is an empty payload, a null url an empty target.

    Of repeated rows with the largest page_id of a payload one is the response.
    """
    from .warc import fresh_folder, read_archives, write_archives

    folder = fresh_folder(spark)
    try:
        write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
        return materialize(read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    finally:
        remove(spark, folder)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document; 0 for a null or empty text, repeated rows alike."""
    import public_tokenizers

    from .tokencount import count_tokens, read_vocabulary

    vocabulary = read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "n_tokens", "token_score")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every url: that of the longest rule that fits, else of trees learned from the rules' own verdicts.

    A null url or one without ``://`` has an empty host and path. Repeated rows are judged alike.
    """
    from .urlfilter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"""list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = """CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END"""

ORACLE_SQL = {
    "op1_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT DISTINCT doc_id, text, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents)),
        b AS (SELECT row_number() OVER () AS item, item_id, w, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS n
              FROM (SELECT DISTINCT item_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM benchmark) WHERE len(w) > 0),
        bp AS (SELECT DISTINCT item, unnest(list_transform(range(1, n + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM b),
        total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM b),
        weight AS (SELECT g, ln(1 + (SELECT n FROM total) / count(*)) AS x FROM bp GROUP BY g),
        whole AS (SELECT item, sum(x) AS x FROM bp JOIN weight USING (g) GROUP BY item),
        kinds AS (SELECT DISTINCT k FROM b),
        dp AS (SELECT r, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g, unnest(range(len(w) - k + 1)) AS p FROM d, kinds WHERE len(w) >= k),
        size AS (SELECT r, k, count(*) AS n FROM dp GROUP BY r, k),
        shared AS (SELECT dp.r, b.item, b.k, b.n AS length, size.n, dp.p FROM dp JOIN bp USING (g) JOIN b ON b.item = bp.item AND b.k = dp.k JOIN size ON size.r = dp.r AND size.k = dp.k),
        win AS (SELECT DISTINCT r, item, k, length, start FROM (SELECT *, unnest(range(greatest(0, p - length + 1), greatest(0, least(p, n - length)) + 1)) AS start FROM shared)),
        inside AS (SELECT DISTINCT win.*, dp.g FROM win JOIN dp ON dp.r = win.r AND dp.k = win.k AND dp.p >= win.start AND dp.p < win.start + win.length),
        score AS (SELECT i.r, i.item, i.start,
                  round(sum(CASE WHEN bp.g IS NOT NULL THEN weight.x ELSE 0 END) / (any_value(whole.x) + ln(1 + (SELECT n FROM total)) * count(*) FILTER (bp.g IS NULL)), 9) AS similarity
                  FROM inside i JOIN whole USING (item) LEFT JOIN bp ON bp.item = i.item AND bp.g = i.g LEFT JOIN weight ON weight.g = i.g GROUP BY i.r, i.item, i.start),
        best AS (SELECT *, row_number() OVER (PARTITION BY r, item ORDER BY similarity DESC, start) AS c FROM score WHERE similarity >= 0.75)
        SELECT d.doc_id, b.item_id, round(similarity, 6) AS similarity, CAST(start AS INTEGER) AS start_word FROM best JOIN d USING (r) JOIN b USING (item) WHERE c = 1
    """,
    "op5_vector_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
        reach AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.vec_id),
        names AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id),
        counts AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT v.vec_id, coalesce(counts.n, 0) AS n_links, names.c AS component_id, names.c = v.vec_id AS kept
        FROM v JOIN names USING (vec_id) LEFT JOIN counts ON counts.a = v.vec_id
    """,
    "op6_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        s AS (SELECT doc_id, list_distinct({_SHINGLES}) AS s FROM d),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        g AS (SELECT doc_id, unnest(s) AS g FROM s),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        half AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        link AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
        reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.doc_id)
        SELECT n.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(reach.c) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id
    """,
    "op7_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
        win AS (SELECT r, unnest(range(len(w) - 34)) AS p, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS t FROM d WHERE len(w) >= 35),
        again AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
        hit AS (SELECT r, p FROM win SEMI JOIN again USING (t)),
        cover AS (SELECT p.r, p.word, p.p, max(CASE WHEN hit.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.r ORDER BY p.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
                  FROM p LEFT JOIN hit ON hit.r = p.r AND hit.p = p.p),
        kept AS (SELECT r, count(*) FILTER (gone = 1) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone = 0), '') AS t FROM cover GROUP BY r)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(kept.n_removed, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        q AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
        m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS kept FROM q)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN kept = page_id THEN NULL ELSE kept END AS refers_to
        FROM m
    """,
}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express over whole tables."""
    return dict(ORACLE_SQL)
