"""Streams: order and lateness, restarts, and batches that are run again."""

import datetime

import pytest
from pyspark.sql import functions as F

from factengine.plans import stream_queries as SQ
from factengine.plans.registry import Tables
from factengine.sources.sinks import scratch
from factengine.streaming import incremental as I, runtime as R, stages as ST

RUNS = "filing_id string, job_run_id bigint, stage string, status string, created_at timestamp"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour, minutes=minute)


def alerts(spark, *shares, stuck_hours=10):
    """Alerts, dropped rows and the stream's folder after each share has landed and been run."""
    home, session, dropped = scratch(spark, "stages_test"), R.stream_session(spark), 0
    for share in shares:
        if share:
            R.land(spark.createDataFrame(share, RUNS), f"{home}/landing")
        stream = session.readStream.schema(RUNS).parquet(f"{home}/landing")
        query = R.run_available(ST.stage_alerts(stream, "1 hour", stuck_hours * 3_600_000), home)
        dropped += R.dropped_late(query)
    found = sorted((r.kind, r.job_run_id, r.stage, r.next_stage) for r in R.stored(spark, home, ST.ALERTS).collect())
    return found, dropped, home


def test_stage_machine_judges_in_order_of_time(spark):
    first = [("F1", 3, "DOWNLOADED", "SUCCEEDED", at(0, 50)), ("F1", 1, "DISCOVERED", "SUCCEEDED", at(0)), ("F2", 9, "PARSED", "RUNNING", at(0, 10)), ("F3", None, "PARSED", "RUNNING", at(0)), (None, 7, "PARSED", "RUNNING", at(0))]
    second = [("F1", 2, "DOWNLOADING", "SUCCEEDED", at(0, 30)), ("F1", 4, "VALIDATING", "SUCCEEDED", at(2)), ("F2", 10, "NORMALIZING", "SUCCEEDED", at(20))]
    third = [("F1", 5, "PUBLISHING", "SUCCEEDED", at(1)), ("", 0, None, None, at(60))]  # the first is too late
    found, dropped, home = alerts(spark, first, second, third, None)
    assert found == [("ILLEGAL_TRANSITION", 2, "DOWNLOADING", "DOWNLOADED"), ("ILLEGAL_TRANSITION", 3, "DOWNLOADED", "VALIDATING"), ("STUCK", 9, "PARSED", None)]
    assert dropped == 1
    states = {r.filing_id: (r.stage, r.status, r.job_run_id) for r in ST.stage_states(R.stream_session(spark), f"{home}/checkpoint").collect()}
    assert states == {"F1": ("VALIDATING", "SUCCEEDED", 4), "F2": ("NORMALIZING", "SUCCEEDED", 10)}


def test_stuck_is_reported_once_and_restarts_add_nothing(spark):
    stuck = [("F1", 1, "PARSING", "RUNNING", at(0)), ("F2", 2, "PARSING", "SUCCEEDED", at(0))]
    found, _, home = alerts(spark, stuck, [("", 0, None, None, at(30))], [("", 0, None, None, at(50))], None, None)
    assert found == [("STUCK", 1, "PARSING", None)]
    files = R.stored(spark, home, ST.ALERTS).count()
    R.run_available(ST.stage_alerts(R.stream_session(spark).readStream.schema(RUNS).parquet(f"{home}/landing"), "1 hour", 36_000_000), home)
    assert R.stored(spark, home, ST.ALERTS).count() == files


@pytest.fixture(scope="module")
def flow(spark, sf_dir):
    t = Tables(spark, sf_dir)
    home = scratch(spark, "incremental_test")
    return t, home, I.IncrementalValidation(home, t.v_filings, t.v_concepts, *SQ.configuration(t))


def test_incremental_batches(spark, flow):
    t, home, validation = flow
    some = t.v_norm.where(F.substring("filing_id", 2, 20).cast("bigint") % 10 == 1)
    rest = t.v_norm.join(some.select("filing_id"), "filing_id", "left_anti")
    judge = lambda facts, batch: validation.judge(facts, batch).write.mode("overwrite").parquet(R.batch_folder(f"{home}/rows", batch))
    judge(rest.select(*t.v_norm.columns), 0)
    one = some.where(F.col("filing_id") == some.agg(F.min("filing_id")).first()[0])
    judge(one, 1)
    changed = one.select("filing_id").distinct()
    want = {r.filing_id for r in I.affected(I.reads(t.v_filings), changed).collect()}
    assert {r.filing_id for r in I.touched(spark, home).where("batch = 1").collect()} == want and 1 <= len(want) <= 8
    before = sorted(map(str, I.current(R.stored(spark, home, I.RESULTS)).collect()))
    judge(one, 1)  # a batch that is run again
    assert sorted(map(str, I.current(R.stored(spark, home, I.RESULTS)).collect())) == before


def test_corrected_facts_replace_earlier_ones(spark, flow):
    t, _, _ = flow
    home = scratch(spark, "corrections_test")
    validation = I.IncrementalValidation(home, t.v_filings, t.v_concepts)
    own = t.v_norm.where(F.col("filing_id") == t.v_norm.agg(F.min("filing_id")).first()[0]).cache()
    broken = own.withColumn("value", F.when(F.col("canonical_concept") == "total_assets", F.lit(-5).cast("decimal(36,18)")).otherwise(F.col("value")))
    result = lambda facts, batch: {r.rule_code: r.result for r in validation.judge(facts, batch).where(F.col("filing_id") == own.first().filing_id).collect()}
    assert result(broken, 0)["SCL-003"] == "FAIL"
    assert result(own.where("canonical_concept = 'total_assets'"), 1)["SCL-003"] == "PASS"


def test_empty_batches_and_results(spark, flow):
    t, _, _ = flow
    home = scratch(spark, "empty_test")
    validation = I.IncrementalValidation(home, t.v_filings.limit(0), t.v_concepts)
    assert validation.judge(t.v_norm.limit(0), 0).collect() == []
    assert R.stored(spark, f"{home}/none", I.RESULTS).collect() == [] and I.touched(spark, f"{home}/none").collect() == []


def test_reads_name_what_rules_read(spark):
    made = [("A1", "A", 2024, "Q1", 1, None), ("A2", "A", 2024, "Q1", 2, "A1"), ("A3", "A", 2024, "Q2", 1, " "), ("B3", "B", 2024, "Q2", 1, "A1")]
    filings = spark.createDataFrame(made, "filing_id string, issuer_code string, fiscal_year int, fiscal_period string, revision_number int, supersedes_filing_id string")
    edges = {(r.filing_id, r.read, r.issuer_code) for r in I.reads(filings).collect()}
    assert edges == {("A1", "A1", "A"), ("A2", "A2", "A"), ("A2", "A1", "A"), ("A3", "A3", "A"), ("A3", "A2", "A"), ("B3", "B3", "B"), ("B3", "A1", "A")}
    touched = lambda *ids: {r.filing_id for r in I.affected(I.reads(filings), spark.createDataFrame([(i,) for i in ids], "filing_id string")).collect()}
    assert touched("A1") == {"A1", "A2", "B3"} and touched("A2") == {"A2", "A3"} and touched("B3") == {"B3"}
