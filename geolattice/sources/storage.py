"""Tables of points and matrices on disk, in a given number of parts; lineage cuts; run records."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), or, on a single machine, a temporary one where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="geolattice-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, label: str = "cut", folder: str | None = None) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder; it outlives lost executors.

    Unlike a checkpoint it states its real size: in a loop of joins the optimizer's
    estimates would else be multiplied round by round.
    """
    path = f"{folder or shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class Scratch:
    """Tables that an operator needs until its result is written; they go at the end of the block, on failure too."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)

    def cut(self, df: DataFrame, label: str = "cut") -> DataFrame:
        return cut(df, label, self.folder)


def read_points(spark: SparkSession, path: str, id_column: str, vector: str) -> DataFrame:
    """(id, v) of a Parquet table."""
    return spark.read.parquet(path).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def save_sparse(matrix: DataFrame, path: str, parts: int = 2) -> None:
    """Write a long-form matrix in ``parts`` files by ranges of rows and columns."""
    matrix.repartitionByRange(parts, "i", "j").write.mode("overwrite").parquet(path)


def load_sparse(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_dense(points: DataFrame, path: str, parts: int = 2) -> None:
    """Write (id, vector) rows in ``parts`` files by ranges of ids."""
    points.repartitionByRange(parts, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def load_dense(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_report(spark: SparkSession, values: Mapping, path: str) -> None:
    """Parameters of a run as one JSON document."""
    spark.createDataFrame([(json.dumps(dict(values), sort_keys=True, default=str),)], "report string").coalesce(1).write.mode("overwrite").text(path)


def load_report(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
