"""A corpus pipeline of five stages; each works on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next one's documents. All but the last return the
columns of ``documents``. Null and empty texts, repeated rows and ids, and empty
tables pass every stage, as its docstring says; columns beyond those of
``documents`` are left behind.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm.bytebpe import encode_documents
from geolattice.llm.decontaminate import keep_uncontaminated
from geolattice.llm.jaccard import keep_one_of_each
from geolattice.llm.session import materialize, prepare
from geolattice.llm.substring import remove_repeats
from geolattice.llm.toxicity import keep_clean
from geolattice.sources.storage import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, does not predict toxic.

    Null and empty texts are judged as texts without words, repeated rows alike. Without
    labels of both kinds, or any, all documents stay.
    """
    prepare(spark)
    return keep_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    Null, empty and blank texts have no copies, and rows without id take no part: all
    of these stay. Rows repeated with the staying id stay, too.
    """
    prepare(spark)
    return keep_one_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur again anywhere, empty if nothing is left.

    Texts without such a passage stay as they are, spaces included, as do null and
    empty ones. A repeated row is another document, so that its passages repeat.
    """
    prepare(spark)
    out = remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("text", text).withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item, of whatever length.

    Null, empty and blank texts stay, as does everything where the benchmark is
    empty; rows equal in id and text go or stay together.
    """
    prepare(spark)
    return keep_uncontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes; a null text is empty, and each row, repeated or not, has its own."""
    prepare(spark)
    out = encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL cannot express the first stage, a learned classifier; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:  # what the stages hand on goes once the last one is written
        for name, stage in STAGES[:-1]:
            docs = scratch.cut(stage(spark, docs, sf_dir), name)
        return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
