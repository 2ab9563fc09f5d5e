"""Wide rows are made once and after the joins; what belongs to a filing is not dealt again."""

import pytest
from pyspark.sql import functions as F
from test_scale import optimized

from factengine.operators import counters as CO, documents as D, quality as Q, rules as R


@pytest.mark.parametrize("name", ["c08_payload_contract", "c34_snapshot_contract"])
def test_payloads_are_joined_before_their_facts(spark, sf_dir, name):
    above = optimized(spark, sf_dir, name).split("AS facts#")[0]
    assert "Join " not in above and "Sort " not in above


def test_counters_judge_each_filing_once(spark, sf_dir):
    assert optimized(spark, sf_dir, "a25_counters_by_version").count("AS owned#") == 1


def test_conflicts_are_told_in_the_filing(spark, sf_dir):
    assert "Generate explode(held" not in optimized(spark, sf_dir, "a09_duplicate_conflicts")


def test_statuses_are_not_joined_to_facts(spark, sf_dir):
    above = optimized(spark, sf_dir, "c29_stamped_facts").split("AS owned#")[0]
    assert "Join " not in above


def test_counts_of_outcomes_need_no_row_for_each(spark, sf_dir):
    assert "Generate" not in optimized(spark, sf_dir, "a05_batch_status")


def test_counted_sets_are_those_a_row_meets(spark):
    rows = spark.createDataFrame([("A", "1", None), ("A", "2", None), (None, None, "X"), (None, None, "X")], "a string, v string, b string")
    got = CO.counted_sets(rows, [(F.col("a").isNotNull(), ["v"], ["a"]), (F.col("b").isNotNull(), [], ["b"])])
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "v=1", "A", 1), ("a", "v=2", "A", 1), ("a", None, "A", 2), ("b", None, "X", 2)]


def test_listed_conflicts_agree_with_grouped_ones(spark):
    """Null is a value of its own, and facts that come twice are named twice."""
    columns = ("source_namespace", "source_concept", "context_ref", "unit_ref")
    facts = [("F1", "a", 1, "x"), ("F1", "b", 2, "x"), ("F1", "c", 2, "y"), ("F2", "a", None, "x"), ("F2", "b", None, "x"), ("F3", "a", None, "x"), ("F3", "b", 1, "x"), ("F3", "a2", 1, "z")]
    df = spark.createDataFrame(facts, "filing_id string, normalized_fact_id string, value int, source_concept string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in columns if c != "source_concept"})
    want = sorted(map(tuple, R.conflicts(df.unionAll(df)).collect()))
    rows = df.groupBy("filing_id").agg(F.sort_array(F.collect_list(R.conflict_fact(df))).alias("facts")).withColumn("times", F.lit(2))
    assert sorted(map(tuple, R.listed_conflicts(rows).collect())) == want and [r[0] for r in want] == ["F1", "F3"]


def test_outcome_counts_agree_with_batch_status(spark):
    rows = [("F1", [("PASS", "INFO"), ("FAIL", "ERROR"), ("SKIPPED", "INFO")]), ("F1", [("FAIL", "WARN")]), ("F2", [("PASS", "INFO")])]
    made = spark.createDataFrame(rows, "filing_id string, outcomes array<struct<result:string,severity:string>>")
    told = made.select("filing_id", F.transform("outcomes", lambda x: F.struct(F.struct(x["result"].alias("result")).alias("o"), x["severity"].alias("severity"))).alias("outcomes"))
    grouped = Q.batch_status(made.select("filing_id", F.explode("outcomes").alias("x")).select("filing_id", "x.*"))
    assert sorted(map(tuple, Q.outcome_counts(told).collect())) == sorted(map(tuple, grouped.collect()))


def test_whole_tree_has_the_text_of_its_parts(spark):
    kind = "struct<b:string,a:array<struct<z:decimal(4,2),y:string,d:date>>,t:timestamp_ntz,n:bigint,f:boolean,s:struct<q:string>>"
    from datetime import date, datetime
    from decimal import Decimal

    rows = [(('x"\\é\n', [(Decimal("1.50"), None, date(2024, 1, 2)), None], datetime(2024, 1, 2, 3, 4, 5, 6), 7, True, None),), ((None, None, None, None, None, (None,)),), (None,)]
    df = D.with_etag(spark.createDataFrame(rows, f"body {kind}"), "body")
    assert [r.document for r in df.collect()] == [
        '{"a":[{"d":"2024-01-02","y":null,"z":"1.50"},null],"b":"x\\"\\\\é\\n","f":true,"n":7,"s":null,"t":"2024-01-02T03:04:05Z"}', '{"a":null,"b":null,"f":null,"n":null,"s":{"q":null},"t":null}', None,
    ]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("to_json") <= 1


def test_outcomes_are_normalized_once(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry
    from factengine.plans import store_queries as SQ

    plans, persist = [], SQ.FS.persist_outcomes
    monkeypatch.setattr(SQ.FS, "persist_outcomes", lambda store, commit, rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or persist(store, commit, rows))
    entry.queries()["c35_persisted_outcomes"](spark, sf_dir)
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_shuffles_of_a_write_go_with_it(spark, tmp_path):
    import glob
    import time

    from factengine.sources.sinks import shuffles_let_go

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, was = files(), spark.conf.get(name)
    with shuffles_let_go(spark):
        spark.range(100).repartition(3, "id").write.parquet(str(tmp_path / "x"))
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(name) == was


def test_archives_pass_by_many():
    from factengine.sources.xbrl import PACK_BYTES, PACK_ROWS, packed

    assert [len(x) for x in packed(range(PACK_ROWS + 1), lambda r: 1)] == [PACK_ROWS, 1]
    assert [len(x) for x in packed(range(3), lambda r: PACK_BYTES)] == [1, 1, 1] and not list(packed([], len))
