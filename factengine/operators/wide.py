"""Facts of a filing side by side: one row per filing and concept first, then conditional aggregates, no pivot scan for the concept list."""

from pyspark.sql import DataFrame, functions as F


def first_values(facts: DataFrame, concepts: list[str], key: str = "filing_id", order: str = "normalized_fact_id") -> DataFrame:
    """key + a column per concept: its first value that is not null, in fact order."""
    named = facts.withColumn("c", F.when(F.col("value").isNotNull() & F.col("canonical_concept").isin(concepts), F.col("canonical_concept")))
    first = named.groupBy(key, "c").agg(F.min_by("value", order).alias("v"))
    return first.groupBy(key).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in concepts])


def last_values(facts: DataFrame, concepts: list[str], key: str = "filing_id", order: str = "normalized_fact_id") -> DataFrame:
    """The batch audit's choice: the last value wins, and dimensioned facts do not count."""
    plain = facts.where(~F.col("dimensioned"))
    value = lambda c: F.max_by("value", F.when((F.col("canonical_concept") == c) & F.col("value").isNotNull(), F.col(order)))
    return plain.groupBy(key).agg(*[value(c).alias(c) for c in concepts])


def evidence(facts: DataFrame, groups: dict[str, list[str]], key: str = "filing_id") -> DataFrame:
    """key + a sorted array of fact ids for each named group of concepts."""
    ids = lambda cs: F.array_sort(F.collect_list(F.when(F.col("canonical_concept").isin(cs), F.col("normalized_fact_id"))))
    return facts.groupBy(key).agg(*[ids(cs).alias(name) for name, cs in groups.items()])
