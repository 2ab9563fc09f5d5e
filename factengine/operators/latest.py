"""Latest-per-group and paging."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.sinks import scratch


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in order. Spark keeps one row per key and task before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def at_latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All rows that have their key's highest version; ties stay."""
    return df.withColumn("_top", F.max(version).over(W.partitionBy(*keys))).where(F.col(version) == F.col("_top")).drop("_top")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a list ordered by unique keys."""
    if size not in (25, 50, 100):
        raise ValueError("pages have 25, 50 or 100 rows")
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def keyset_page(df: DataFrame, time: str, key: str, after: tuple | None = None, limit: int = 25) -> DataFrame:
    """The newest ``limit`` rows older than the cursor, with ``has_more`` on each."""
    limit = min(max(limit, 1), 100)
    if after is not None:
        at, name = (F.lit(v) for v in after)
        df = df.where((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < name)))
    some = df.orderBy(F.desc(time), F.desc(key)).limit(limit + 1)  # one more row tells whether a page follows
    n = F.row_number().over(W.orderBy(F.desc(time), F.desc(key)))
    return some.withColumn("_n", n).withColumn("has_more", F.max("_n").over(W.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def page_with_total(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page with the number of all rows beside each of its rows."""
    total = df.agg(F.count("*")).scalar()
    return page(df, order, number, size).withColumn("total", total)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with ``name``, each row's number in the whole order, from 1.

    Rows are sorted in ranges and written once; a row's number is its place in its
    range and the count of the ranges before, so no task sees all rows.
    """
    path = scratch(df.sparkSession, "numbered")
    df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_id", 33))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return rows.join(counts.select("_range", before.alias("_before")), "_range").withColumn(name, place).drop("_id", "_range", "_before")
