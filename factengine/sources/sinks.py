"""Idempotent writes to plain parquet: anti-join, then append. One writer per table and batch."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{shared}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_let_go(spark: SparkSession):
    """Writes that start in here delete their shuffles' files when they end, so that a job of several writes holds those of one; the session's setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def new_rows(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, one per key."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def append_new(rows: DataFrame, path: str, keys: list[str], partition_by: list[str] = ()) -> int:
    """Append the rows whose key the table at path lacks; returns how many. A second run adds none.

    Of the stored table only the keys are read, and with ``partition_by``, whose
    columns must follow from the key, only the partitions that the batch has
    rows in. The rows are counted while they are written.
    """
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    if exists(spark, path):
        stored = spark.read.parquet(path).select(*{*keys, *partition_by})
        if partition_by:
            stored = stored.join(rows.select(*partition_by).distinct(), list(partition_by), "left_semi")
        fresh = new_rows(rows, stored, keys)
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*partition_by).parquet(path)
    return seen.get["n"]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def documents_json(documents: DataFrame, columns: list[str], name: str = "document") -> DataFrame:
    """documents with their canonical JSON text and its etag."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return documents.withColumn(name, text).withColumn("etag", F.concat(F.lit("sha256-"), F.sha2(F.col(name), 256)))


def export_documents(documents: DataFrame, path: str, name_column: str, text_column: str = "document") -> None:
    """One text file per document, in a folder named after it."""
    documents.select(F.col(text_column).alias("value"), F.col(name_column).alias("name")).write.mode("overwrite").partitionBy("name").text(path)
