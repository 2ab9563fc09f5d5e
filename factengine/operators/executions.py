"""Executions of a filing as versions: several sets of facts and results beside each other, one of which counts at a time."""

from pyspark.sql import Column, DataFrame, functions as F

PAIR = ["filing_id", "dataset_version", "rule_set_version"]


def latest_execution(executions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(filing_id, execution_id, dataset_version, rule_set_version) of each filing's latest complete execution.

    executions: execution_id, filing_id, dataset_version, rule_set_version, finished_at, complete; an execution without
    both versions or an end is none, and of those that ended at one time the greatest id counts. ``as_of`` leaves out
    executions that ended later, so a past state can be read again.
    """
    c = F.col
    good = c("complete") & c("dataset_version").isNotNull() & c("rule_set_version").isNotNull() & c("finished_at").isNotNull()
    known = executions.where(good if as_of is None else good & (c("finished_at") <= as_of))
    top = F.max_by(F.struct("execution_id", "dataset_version", "rule_set_version"), F.struct("finished_at", "execution_id"))
    return known.groupBy("filing_id").agg(top.alias("e")).select("filing_id", "e.*")


def of_execution(latest: DataFrame, results: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results of the latest executions' pair of versions, whatever execution gave them, and the facts of its data set."""
    kept = results.join(latest.select(*PAIR), PAIR, "left_semi")
    return kept, facts.join(latest.select("filing_id", "dataset_version"), ["filing_id", "dataset_version"], "left_semi")


def mixed_versions(executions: DataFrame, results: DataFrame) -> DataFrame:
    """(filing_id, dataset_version, rule_set_version, results) whose pair of versions no complete execution has: lineage that must not be published."""
    known = executions.where("complete").select(*PAIR).distinct()
    return results.join(known, PAIR, "left_anti").groupBy(*PAIR).agg(F.count("*").alias("results"))
