"""Referential and contract checks, as tables of violations instead of exceptions."""

from pyspark.sql import DataFrame, functions as F


def foreign_key_violations(rows: DataFrame, parents: DataFrame, key: str, id_column: str, name: str) -> DataFrame:
    """(violation, id) of rows whose key is set and has no parent."""
    orphans = rows.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")
    return orphans.select(F.lit(name).alias("violation"), F.col(id_column).alias("id"))


def duplicates(rows: DataFrame, id_column: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(id_column).alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.lit(name).alias("records"), "id", "n")


def test_pack(pack: DataFrame, facts: DataFrame) -> DataFrame:
    """(test_id, matches, passes): a test passes with exactly one undimensioned fact of the expected unit, nil flag and value."""
    f = facts.where(~F.col("dimensioned")).select("filing_id", "canonical_concept", "normalized_fact_id", "unit_ref", "is_nil", "value")
    same = (F.col("unit_ref") == F.col("expected_unit")) & (F.col("is_nil") == F.col("expected_nil")) & F.col("value").eqNullSafe(F.col("expected_value"))
    found = pack.join(f, ["filing_id", "canonical_concept"], "left").groupBy("test_id").agg(F.count("normalized_fact_id").alias("matches"), F.bool_and(same).alias("same"))
    return found.select("test_id", "matches", ((F.col("matches") == 1) & F.coalesce("same", F.lit(False))).alias("passes"))
