"""Statuses and counts from rule results."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

STATUSES = ("VERIFIED", "REVIEW_REQUIRED", "FAILED")


def status_rank(result: Column, severity: Column) -> Column:
    return F.when((result == "FAIL") & (severity == "ERROR"), 2).when(result.isin("FAIL", "REVIEW_REQUIRED"), 1).otherwise(0)


def filing_status(results: DataFrame, floor: DataFrame | None = None) -> DataFrame:
    """(filing_id, status): the worst of a filing's results, and of its floor (filing_id, floor) where given."""
    worst = results.groupBy("filing_id").agg(F.max(status_rank(F.col("result"), F.col("severity"))).alias("rank"))
    if floor is not None:
        least = F.when(F.col("floor") == "FAILED", 2).when(F.col("floor") == "REVIEW_REQUIRED", 1).otherwise(0)
        worst = worst.join(floor, "filing_id", "left").withColumn("rank", F.greatest("rank", least))
    return worst.select("filing_id", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("rank") + 1).alias("status"))


def outcome_status(outcomes: DataFrame) -> DataFrame:
    """outcomes (filing_id, outcomes) + status: the worst of a filing's results, without a shuffle."""
    rank = F.array_max(F.transform("outcomes", lambda x: status_rank(x["o"]["result"], x["severity"])))
    return outcomes.withColumn("status", F.element_at(F.array(*map(F.lit, STATUSES)), F.coalesce(rank, F.lit(0)) + 1))


def batch_status(results: DataFrame) -> DataFrame:
    """(filing_id, errors, warnings, infos, status) by severities."""
    n = lambda s: F.sum(F.when(s, 1).otherwise(0)).alias
    bad = F.col("result") != "PASS"
    return _by_counts(results.groupBy("filing_id").agg(n(F.col("severity") == "ERROR")("errors"), n(F.col("severity") == "WARN")("warnings"), n(bad & (F.col("severity") == "INFO"))("infos")))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """batch_status of outcomes (filing_id, outcomes), which are counted in the filing's row; rows of one filing, of which there may be several, are added up."""
    said = F.col("outcomes.severity")
    n = lambda severity: F.size(said) - F.size(F.array_remove(said, severity))
    infos = F.size(F.filter("outcomes", lambda x: (x["severity"] == "INFO") & (x["o"]["result"] != "PASS")))
    rows = outcomes.select("filing_id", n("ERROR").alias("errors"), n("WARN").alias("warnings"), infos.alias("infos"))
    return _by_counts(rows.groupBy("filing_id").agg(*[F.sum(c).alias(c) for c in ("errors", "warnings", "infos")]))


def _by_counts(out: DataFrame) -> DataFrame:
    return out.withColumn("status", F.when(F.col("errors") > 0, "FAILED").when(F.col("warnings") > 0, "REVIEW_REQUIRED").otherwise("VERIFIED"))


def distribution(statuses: DataFrame, column: str = "status") -> DataFrame:
    """(status, filings, basis_points): shares in exact hundredths of a percent, rounded down."""
    counts = statuses.groupBy(column).agg(F.count("*").alias("filings"))
    total = F.sum("filings").over(W.partitionBy())  # a row per status
    return counts.select(column, "filings", F.floor(F.col("filings") * 10000 / total).cast("bigint").alias("basis_points"))


def counts(results: DataFrame, key: str = "filing_id") -> DataFrame:
    """Results by outcome and severity, zero-filled."""
    n = lambda col, v: F.sum(F.when(F.col(col) == v, 1).otherwise(0)).cast("bigint")
    outcomes = [n("result", v).alias(f"n_{v.lower()}") for v in ("PASS", "FAIL", "REVIEW_REQUIRED", "SKIPPED")]
    severities = [n("severity", v).alias(f"n_{v.lower()}") for v in ("ERROR", "WARN", "INFO")]
    return results.groupBy(key).agg(F.count("*").alias("total"), *outcomes, *severities)
