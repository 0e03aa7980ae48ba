"""Session helpers: settings, lineage cuts, samples and columns' names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..sources.storage import Scratch, cut


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package; and where the session still has Spark's own 10,000 rows an Arrow batch, take at most 2,000 rows or 8 MB: texts are long, and both sides hold whole batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return ship(spark)


def materialize(df: DataFrame, label: str, scratch: Scratch | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (in ``scratch``, if it is only needed there) and read it back: a lineage cut that survives lost executors."""
    return scratch.cut(df, label) if scratch else cut(df, label)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as set it apart from the columns of ``df``; Spark does not tell case apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those of these names, in any case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


BUCKET_BYTES = 8 << 20


def bucket_bits(spark: SparkSession, size: int) -> int:
    """log2 of the number of hash buckets for ``size`` bytes: about BUCKET_BYTES each, and at least four a shuffle partition, so that buckets even out over tasks."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(5, min(26, math.ceil(math.log2(max(4 * parts, size / BUCKET_BYTES)))))


def hashed_sample(df: DataFrame, key: Column, limit: int, rows: int | None = None) -> DataFrame:
    """About ``limit`` rows (a few per cent more, never all tasks' shares) with the smallest hashes of ``key``; a bounded sample of labelled rows.

    The share to keep follows from the number of rows, so that tasks send what is
    needed and no more.
    """
    rows = df.count() if rows is None else rows
    if rows <= limit:
        return df
    share = min(1.0, (limit + 4 * math.sqrt(limit)) / rows)
    return df.where(F.shiftrightunsigned(F.xxhash64(key, F.lit(77)), 1) <= int(share * ((1 << 63) - 1)))


def schema_of(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """The schema of the named columns of ``df`` followed by ``more``, in DDL."""
    return T.StructType([*(df.schema[c] for c in names), *T.StructType.fromDDL(more).fields])
