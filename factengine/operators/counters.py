"""Counters of a release by its versions, one scan for each table: all groupings of a table in one GROUPING SETS, or from the groups of all its columns."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

COUNTERS = "counter string, version string, key string, n bigint"


def counted(rows: DataFrame, versions: list[str], keys: list[str]) -> DataFrame:
    """COUNTERS of rows: for every key column its values, in all and by each version column; ``version`` is ``column=value``, null in all.

    One shuffle of pre-aggregated groups, whatever the number of columns.
    """
    sets, columns = [], [*versions, *keys]
    for key in keys:
        sets += [[F.col(key)], *([F.col(v), F.col(key)] for v in versions)]
    groups = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).groupingSets(sets, *columns)
    out = groups.agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"__{c}") for c in columns])
    name = F.concat(*[F.when(F.col(f"__{k}") == 0, k).otherwise("") for k in keys])
    key = F.concat(*[F.when(F.col(f"__{k}") == 0, F.col(k)).otherwise("") for k in keys])
    version = F.concat(*[F.when(F.col(f"__{v}") == 0, F.concat(F.lit(f"{v}="), v)).otherwise("") for v in versions]) if versions else F.lit("")
    return out.select(name.alias("counter"), F.nullif(version, F.lit("")).alias("version"), key.alias("key"), "n")


def counted_sets(rows: DataFrame, sets: Sequence[tuple[Column, list[str], list[str]]]) -> DataFrame:
    """counted of several sets of columns in one pass: a row counts in the sets whose condition, over these columns, it meets. Rows are counted by all columns, and the few groups, not rows, are taken several times."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entry = lambda key, version: F.struct(F.lit(key).alias("counter"), version.cast("string").alias("version"), text(key).alias("key"))
    entries = [F.when(cond, entry(k, v)) for cond, versions, keys in sets for k in keys for v in (F.lit(None), *(F.concat(F.lit(f"{v}="), text(v)) for v in versions))]
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    out = groups.select(F.explode(F.array(*entries)).alias("c"), "__n").where(F.col("c").isNotNull())
    return out.groupBy("c.counter", "c.version", "c.key").agg(F.sum("__n").alias("n"))


def observed(rows: DataFrame, conditions: dict) -> tuple[DataFrame, Observation]:
    """rows with an observation that counts all of them and those of each condition while they are written; no scan of its own."""
    seen = Observation()
    n = [F.count(F.when(cond, 1)).alias(name) for name, cond in conditions.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *n), seen
