"""Canonical documents and their files, executions, counters, archives."""

import datetime
import hashlib
import json
import zipfile
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factengine.operators import counters as CO, documents as D, executions as EX
from factengine.sources import xbrl as X
from factengine.sources.sinks import scratch

BODY = "body struct<z:string,a:struct<n:decimal(10,2),b:boolean,i:int>,list:array<struct<y:string,x:date>>,m:map<string,bigint>,t:timestamp>"


def test_canonical_json(spark):
    at = datetime.datetime(2024, 3, 1, 12, 30, 5)
    rows = [
        (1, ('say "é"\n\\/', (Decimal(1), True, None), [("q", datetime.date(2024, 2, 29)), (None, None)], {"k2": 2, "k1": None}, at)),
        (2, (None, None, [], {}, None)),
        (3, None),
        (4, ("", None, None, None, None)),
    ]
    got = {r.id: r for r in D.with_etag(spark.createDataFrame(rows, f"id int, {BODY}"), "body").collect()}
    assert got[1].document == '{"a":{"b":true,"i":null,"n":"1.00"},"list":[{"x":"2024-02-29","y":"q"},{"x":null,"y":null}],"m":{"k1":null,"k2":2},"t":"2024-03-01T12:30:05Z","z":"say \\"é\\"\\n\\\\/"}'
    assert json.loads(got[1].document)["z"] == rows[0][1][0]
    assert got[2].document == '{"a":null,"list":[],"m":{},"t":null,"z":null}' and got[3].document is None and got[3].etag is None
    assert got[4].document == '{"a":null,"list":null,"m":null,"t":null,"z":""}'
    assert got[2].etag == "sha256-" + hashlib.sha256(got[2].document.encode()).hexdigest()
    with pytest.raises(TypeError):
        D.with_etag(spark.createDataFrame([(1.5,)], "v double").select(F.struct("v").alias("body")), "body")


def test_files_hold_documents_at_their_offsets(spark):
    rows = spark.range(400).selectExpr("concat('N', id) as filing_id", "concat('{\"id\":', id, ',\"s\":\"', repeat('é', cast(id % 7 as int)), '\"}') as document").withColumn("etag", F.sha2("document", 256))
    rows = rows.unionByName(spark.createDataFrame([("none", None, None)], rows.schema))
    path = scratch(spark, "export_test")
    index = D.export_files(rows, path, file_bytes=2000).collect()
    assert len(index) == 400 and len({r.file for r in index}) > 3
    folder = Path(path.removeprefix("file:"))
    for r in index[::17]:
        (file,) = (folder / "files" / f"part={r.file}").glob("*.txt")
        found = file.read_bytes()[r.offset : r.offset + r.length]
        assert hashlib.sha256(found).hexdigest() == r.etag
    again = D.export_files(rows.repartition(5), path + "-again", file_bytes=2000)
    assert sorted(again.collect()) == sorted(index)
    assert D.read_files(spark, path).count() == 400
    assert D.export_files(rows.limit(0), path + "-empty").collect() == [] and D.read_files(spark, path + "-empty").collect() == []


EXEC = "execution_id bigint, filing_id string, dataset_version string, rule_set_version string, finished_at timestamp, complete boolean"


def test_latest_execution(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, "A", "d1", "r1", day(1), True), (2, "A", "d2", "r1", day(2), True), (3, "A", "d3", "r1", day(3), False), (4, "B", None, "r1", day(1), True), (5, "C", "d1", "r1", day(1), True), (6, "C", "d2", "r2", day(1), True), (7, "D", "d1", "r1", None, True)]
    made = spark.createDataFrame(rows, EXEC)
    latest = EX.latest_execution(made)
    assert {r.filing_id: r.execution_id for r in latest.collect()} == {"A": 2, "C": 6}
    assert {r.filing_id: r.execution_id for r in EX.latest_execution(made, F.lit("2024-01-01").cast("timestamp")).collect()} == {"A": 1, "C": 6}
    results = spark.createDataFrame([("A", "d2", "r1", 1), ("A", "d2", "r2", 2), ("A", "d1", "r1", 3), ("B", "d1", "r1", 4)], "filing_id string, dataset_version string, rule_set_version string, n int")
    facts = spark.createDataFrame([("A", "d2", "x"), ("A", "d1", "y"), ("C", "d2", "z")], "filing_id string, dataset_version string, f string")
    kept, own = EX.of_execution(latest, results, facts)
    assert [r.n for r in kept.collect()] == [1] and sorted(r.f for r in own.collect()) == ["x", "z"]
    assert {(r.filing_id, r.dataset_version, r.rule_set_version) for r in EX.mixed_versions(made, results).collect()} == {("A", "d2", "r2"), ("B", "d1", "r1")}


def test_counters(spark):
    rows = spark.createDataFrame([("v1", "m1", "GOOD", None), ("v1", "m2", "BAD", "x"), ("v2", None, "GOOD", "x")], "v string, m string, status string, reason string")
    counted = CO.counted(rows, ["v", "m"], ["status", "reason"])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    got = {(r.counter, r.version, r.key): r.n for r in counted.collect()}
    assert got[("status", None, "GOOD")] == 2 and got[("status", "v=v1", "GOOD")] == 1 and got[("status", "m=", "GOOD")] == 1
    assert got[("reason", None, "")] == 1 and got[("reason", None, "x")] == 2 and got[("reason", "m=m2", "x")] == 1
    assert plan.count("Exchange") == 1 and len(got) == len(counted.collect())
    kept, seen = CO.observed(rows, {"bad": F.col("status") == "BAD"})
    kept.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "bad": 1}


def test_archives_within_bounds(spark, tmp_path):
    made = spark.createDataFrame([("F1", "<a/>", "http://x/financesharia", 0), ("F2", "<a/>", "n", 5), ("F3", "<a/>", "n", 7), ("F4", "<a/>", "n", 11)], "filing_id string, document string, namespace string, kind int")
    zips = X.zipped(made)
    rows = zips.unionByName(spark.createDataFrame([("none", None)], zips.schema))
    got = {r.filing_id: (r.problem, r.entry_point, r.document) for r in X.open_archives(rows, 50_000).collect()}
    assert got == {"I-F1": (None, "financesharia", "<a/>"), "I-F2": ("BAD_ARCHIVE", None, None), "I-F3": ("NO_INSTANCE", "general", None), "I-F4": ("TOO_LARGE", None, None), "none": ("BAD_ARCHIVE", None, None)}
    assert X.open_archives(rows.limit(0)).collect() == []
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for issuer, size in (("AA", 10), ("BB", 90_000)):
        folder = tmp_path / issuer / "2024Q1"
        folder.mkdir(parents=True)
        with zipfile.ZipFile(folder / "f.zip", "w") as z:  # stored, so the file is as large as its member
            z.writestr("a.xbrl", "x" * size)
    found = {r.filing_id: (r.problem, r.issuer_code, r.period) for r in X.read_archives(spark, str(tmp_path), 50_000).collect()}
    assert found == {"AA-2024Q1": (None, "AA", "2024Q1"), "BB-2024Q1": ("TOO_LARGE", "BB", "2024Q1")}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_schema_metadata_of_odd_schemas(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "<schema/>"), ("d", "<schema targetNamespace='n'><!-- x --><import/><linkbaseRef href='z'/><linkbaseRef href='y'/></schema>")], "filing_id string, schema string")
    got = {r.filing_id: r for r in X.schema_metadata(rows).collect()}
    assert got["a"].error and got["b"].error and not got["c"].error and got["c"].imports == [] and got["c"].target_namespace is None
    assert (got["d"].target_namespace, got["d"].imports, got["d"].linkbase_references, got["d"].linkbase_roles) == ("n", [], ["y", "z"], [])
    assert X.schema_metadata(rows.limit(0)).collect() == []
