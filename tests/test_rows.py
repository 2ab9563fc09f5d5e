"""What belongs to a filing is told in its row: facts are not exploded to be collected again, and rules and documents are read once."""

import pytest
from pyspark.sql import functions as F
from test_scale import optimized

from factengine.operators import publish as P, rules as R


@pytest.mark.parametrize("name", ["c07_payload", "j13_result_facts", "j20_foreign_evidence", "c32_validation_detail", "c29_stamped_facts"])
def test_facts_stay_in_their_filing(spark, sf_dir, name):
    assert "Generate explode(held" not in optimized(spark, sf_dir, name)


@pytest.mark.parametrize("name", ["u03_rule_completeness", "a23_release_counters", "a20_case_parity"])
def test_rules_are_judged_once(spark, sf_dir, name):
    assert optimized(spark, sf_dir, name).count("AS owned#") == 1


def test_documents_are_parsed_once(spark, sf_dir):
    assert "MapInArrow" not in optimized(spark, sf_dir, "s06_xbrl_extraction")


def test_contexts_join_lines_once(spark, sf_dir):
    assert optimized(spark, sf_dir, "j01_fact_context").count("Join ") == 1


def test_told_limitations_agree_with_grouped_ones(spark):
    """Nulls, repeated evidence, and filings with nothing to say or without facts."""
    outcome = "struct<rule_code:string,rule_version:bigint,o:struct<result:string,message:string,evidence:array<string>>,severity:string>"
    one = lambda code, result, severity, *evidence: (code, 1, (result, f"{code}.", list(evidence)), severity)
    rows = [
        ("F1", [one("B", "SKIPPED", "INFO", "y", "x", "y"), one("A", "FAIL", "ERROR", "x")], [("x", False, None), ("y", True, None), ("z", False, 1)]),
        ("F2", [one("A", "PASS", "INFO")], [("x", False, 1)]), ("F3", [one("C", "FAIL", "WARN")], None),
    ]
    told = spark.createDataFrame(rows, f"filing_id string, outcomes array<{outcome}>, facts array<struct<normalized_fact_id:string,is_nil:boolean,value:int>>")
    results = told.select("filing_id", F.explode("outcomes").alias("r")).select("filing_id", "r.*").select("filing_id", "rule_code", "severity", "o.*")
    available = F.when(F.col("is_nil"), "NIL").when(F.col("value").isNull(), "MISSING").otherwise("AVAILABLE")
    facts = told.select("filing_id", F.explode("facts").alias("f")).select("filing_id", "f.*").withColumn("availability", available)
    got = {r.filing_id: r["items"] for r in R.only(told.select("filing_id", P.told_items().alias("items")), "items").collect()}
    assert got == {r.filing_id: r["items"] for r in P.limitations(results, facts).collect()} and sorted(got) == ["F1", "F3"]
    assert [r.filing_id for r in R.only(told, "facts").collect()] == ["F1", "F2"]


@pytest.mark.parametrize("name", ["a06_status_distribution", "r18_crx_002", "c32_validation_detail"])
def test_facts_are_made_after_the_last_join(spark, sf_dir, name):
    """A row that holds its filing's facts is some kilobytes: joins sort the narrow rows that facts are made from."""
    above = optimized(spark, sf_dir, name).split("AS owned#")[0]
    assert "Join " not in above and "Sort " not in above


def test_rules_are_not_read_inside_a_lambda(spark, sf_dir):
    """An expression over lambdas is interpreted with all its arguments, so each rule is a column of its own below it."""
    plan = optimized(spark, sf_dir, "a06_status_distribution")
    assert "Assets against liabilities and equity." not in plan.split("AS o_ACC-001#")[0].rsplit("Project [", 1)[0]
    assert "AS o_ACC-001#" in plan
