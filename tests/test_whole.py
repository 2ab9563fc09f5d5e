"""Queries that do the whole job beside those whose checking SQL cuts it."""

import __spark_entry__ as entry


def run(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)


def test_batch_audit_counts_all_rules(spark, sf_dir):
    five, whole = ({r.filing_id: r for r in run(spark, sf_dir, n).collect()} for n in ("c05_batch_audit", "c24_whole_batch_audit"))
    assert five.keys() == whole.keys() and all(r.rules == 15 for r in whole.values())
    assert all(whole[i].errors >= r.errors and whole[i].warnings >= r.warnings for i, r in five.items())
    assert any(whole[i].errors > r.errors for i, r in five.items())


def test_requests_take_every_filing(spark, sf_dir):
    filings = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    whole = run(spark, sf_dir, "c25_whole_reprocess_set").cache()
    assert whole.select("filing_id").distinct().count() == filings
    outside = run(spark, sf_dir, "j25_all_outside_impact")
    assert outside.count() > run(spark, sf_dir, "j18_outside_impact").count()
    assert outside.join(whole.select("mapping_rule_id", "filing_id"), ["mapping_rule_id", "filing_id"], "left_anti").count() == 0


def test_foreign_evidence_of_every_rule(spark):
    from factengine.plans.norm_queries import foreign_evidence

    class Given:
        v_norm = spark.createDataFrame([("F1", "F1-1", False), ("F1", "F1-2", True)], "filing_id string, normalized_fact_id string, dimensioned boolean")

    results = spark.createDataFrame([("F1", "ACC-001", ["F1-1", "F9-1"]), ("F1", "HRY-006", ["F1-2"]), ("F1", "CTX-004", ["F1-1"])], "filing_id string, rule_code string, evidence array<string>")
    found = foreign_evidence(Given, results).collect()
    assert sorted(map(tuple, found)) == [("F1", "ACC-001", "F9-1"), ("F1", "HRY-006", "F1-2")]


def test_versions_of_all_years(spark, sf_dir):
    got = run(spark, sf_dir, "c26_create_all_versions")
    assert got.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "request_id" not in "".join(x for x in plan.splitlines() if "Window" in x)


def test_every_current_mapping_is_asked_for_each_filing(spark, sf_dir):
    from factengine.plans.registry import Tables

    t = Tables(spark, sf_dir)
    whole = run(spark, sf_dir, "c25_whole_reprocess_set")
    assert whole.count() == t.v_filings.count() * t.v_current.count()
