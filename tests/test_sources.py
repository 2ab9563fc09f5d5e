import json

import pytest
from pyspark.sql import functions as F

from factengine.operators import normalize as N
from factengine.sources import files as FS, sinks, xbrl as X
from factengine.streaming import flows

NS = 'xmlns="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:e="http://e" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
DOC = (
    f'<xbrl {NS}><context id="c1"><entity><identifier scheme="s">E1</identifier></entity><period><instant>2024-12-31</instant></period><scenario><d:explicitMember dimension="e:Axis">e:Gold</d:explicitMember></scenario></context>'
    '<context id="c2"><entity><identifier scheme="s"> </identifier></entity><period><startDate>2024-01-01</startDate><endDate>2024-12-31</endDate></period></context>'
    '<unit id="u1"><measure>iso4217:IDR</measure></unit><unit id="u2"><divide><unitNumerator><measure>iso4217:IDR</measure></unitNumerator><unitDenominator><measure>xbrli:shares</measure></unitDenominator></divide></unit>'
    '<e:Assets contextRef="c1" unitRef="u1" decimals="-6">007.50</e:Assets><e:Assets contextRef="c1" unitRef="u1" decimals="-6">007.50</e:Assets>'
    '<e:Lost contextRef="nowhere" unitRef="u1">1</e:Lost><e:Nil contextRef="c2" unitRef="u1" xsi:nil="true"/><e:Bad contextRef="c2" unitRef="u1">x1</e:Bad><e:Note contextRef="c2">text</e:Note></xbrl>'
)


def test_xbrl(spark):
    docs = spark.createDataFrame([("F1", DOC), ("F2", "<broken"), ("F3", "<other/>"), ("F4", None), ("F5", "<!DOCTYPE x [<!ENTITY a 'b'>]><x/>")], "filing_id string, document string")
    rows = X.extract(docs).cache()
    assert {r.filing_id for r in rows.where("record = 'rejected'").collect()} == {"F2", "F3", "F4", "F5"}
    assert {(r.source_context_id, r.period_type, r.context_status) for r in X.contexts(rows).collect()} == {("c1", "INSTANT", "RESOLVED"), ("c2", "DURATION", "INVALID")}
    assert {(r.unit_type, r.measure, r.currency) for r in X.units(rows).collect()} == {("CURRENCY", "iso4217:IDR", "IDR"), ("RATIO", "iso4217:IDR/xbrli:shares", None)}
    assert [(r.axis, r.member) for r in X.dimensions(rows).collect()] == [("e:Axis", "e:Gold")]
    facts = {(r.source_concept, r.occurrence): r for r in X.facts(rows).collect()}
    assert set(facts) == {("Assets", 0), ("Assets", 1), ("Nil", 0), ("Bad", 0), ("Note", 0)}
    assert facts["Assets", 0].raw_value == "007.50" and facts["Bad", 0].fact_status == "PARSE_ERROR" and facts["Nil", 0].is_nil and facts["Note", 0].fact_status == "EXTRACTED"
    assert [(r.n, r.suppressed) for r in X.warnings(X.facts(rows)).collect()] == [(1, 0)]


def test_archives(spark, tmp_path):
    import zipfile

    for issuer, period, namespace in (("AAA", "2024Q1", "http://x/financesharia"), ("BBB", "2024Q2", None)):
        folder = tmp_path / issuer / period
        folder.mkdir(parents=True)
        with zipfile.ZipFile(folder / "instance.zip", "w") as z:
            z.writestr("a.xbrl", DOC)
            if namespace:
                z.writestr("Taxonomy.xsd", f'<schema targetNamespace="{namespace}"/>')
    (tmp_path / "CCC" / "2024Q1").mkdir(parents=True)
    (tmp_path / "CCC" / "2024Q1" / "instance.zip").write_bytes(b"no zip")
    got = {r.filing_id: r for r in X.read_archives(spark, str(tmp_path)).collect()}
    assert (got["AAA-2024Q1"].entry_point, got["BBB-2024Q2"].entry_point) == ("financesharia", "general")
    assert got["CCC-2024Q1"].error and got["BBB-2024Q2"].document == DOC


def test_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(",".join(FS.MAPPING) + "\nAssets,http://n,a;b,total_assets,CONFIRMED,why,me\n,,,,,,\n")
    rows = FS.read_csv(spark, str(good), FS.MAPPING)
    assert rows.count() == 1
    assert sorted((r.entry_point, r.status, r.rule_version) for r in FS.import_mappings(rows, "v3").collect()) == [("a", "APPROVED", 3), ("b", "APPROVED", 3)]
    bad = tmp_path / "bad.csv"
    bad.write_text(",".join(reversed(FS.MAPPING)) + "\n1,2,3,4,5,6,7\n")
    with pytest.raises(Exception, match="header does not conform"):
        FS.read_csv(spark, str(bad), FS.MAPPING).collect()
    ragged = tmp_path / "ragged.csv"
    ragged.write_text(",".join(FS.MAPPING) + "\na,b,c,d,e,f,g\na,b\n")
    ok, broken = FS.read_csv_report(spark, str(ragged), FS.MAPPING)
    assert (ok.count(), broken.count()) == (1, 1)
    words = tmp_path / "dictionary.csv"
    words.write_text(",".join(FS.DICTIONARY) + "\ngross_profit,income,d, duration,s,group;single,required,a - b\n")
    r = FS.import_dictionary(FS.read_csv(spark, str(words), FS.DICTIONARY)).first()
    assert (r.period_type, r.allowed_scope) == ("DURATION", "CONSOLIDATED;PARENT")
    cases = tmp_path / "cases.csv"
    cases.write_text(",".join(FS.CASES) + '\nT1,ACC-001,a,b,c,d,"{""total_assets"": 5}",PASS,VERIFIED,m\n')
    assert FS.read_cases(spark, str(cases), "total_assets bigint").first().input.total_assets == 5


def candidate(**more):
    return {"filing_id": "F1", "issuer_code": "abc", "period_end": "2024-03-31", "source_url": "https://a.test/x", "source_type": "pdf", "source_hash": "h", "revision_number": 1, **more}


def test_candidates(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([candidate(), candidate(surprise=1)]))
    (tmp_path / "envelope.json").write_text(json.dumps({"candidates": [candidate(period_end="2024-02-30"), candidate(storage_path="../x"), candidate(source_url="http://10.0.0.1/x")]}))
    rows = FS.check_candidates(FS.read_candidates(spark, str(tmp_path)), ["a.test", "10.0.0.1"])
    assert sorted(str(r.problem) for r in rows.collect()) == ["None", "period end", "source url", "storage path", "unknown field"]


def result(**more):
    fact = {"raw_fact_id": "r1", "filing_id": "F1", "context_ref": "c1", "raw_value": "5", "is_nil": False, "fact_status": "EXTRACTED"}
    base = {"parser_contract": "xbrl_parser_result", "parser_contract_version": "2.0.0", "status": "SUCCESS", "filing_id": "F1", "counts": {"contexts": 1, "units": 0, "dimensions": 0, "facts": 1}, "contexts": [{"context_id": "c1", "period_type": "INSTANT"}], "units": [], "dimensions": [], "facts": [fact]}
    return json.dumps({**base, **more})


def test_parser_results(spark):
    texts = [result(), result(filing_id="F2", contexts=[], counts={"contexts": 1, "units": 0, "dimensions": 0, "facts": 1}), result(filing_id="F3", dimensions=[{"dimension_id": "d", "context_id": "zz"}])]
    parsed = FS.parse_results(spark.createDataFrame([(t,) for t in texts], "value string"))
    found = {(r.filing_id, r.violation) for r in FS.result_violations(parsed, "2.0.0").collect()}
    assert found == {("F2", "count of contexts"), ("F2", "fact context"), ("F3", "count of dimensions"), ("F3", "dimension context")}
    assert FS.record_sets(parsed)["facts"].count() == 3


def test_sinks_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert [sinks.append_new(rows, path, ["k"]) for _ in range(2)] == [2, 0]
    docs = sinks.documents_json(rows.dropDuplicates(), ["k", "v"])
    sinks.export_documents(docs, str(tmp_path / "docs"), "v")
    assert spark.read.text(str(tmp_path / "docs")).count() == 2


FACT = "raw_fact_id string, filing_id string, source_concept string, source_namespace string, raw_value string, is_nil boolean, entry_point string, scope string, period_type string, start_date date, end_date date, instant_date date, dimensioned boolean, unit_currency string, fiscal_period string"
MAP = "mapping_rule_id string, source_concept string, source_namespace string, entry_point string, canonical_concept string, allowed_scope string, period_type string, sign_convention string, status string, rule_version bigint, dimension_policy string"


def normalize_inputs(spark):
    fact = lambda i, concept, value="5", nil=False, ns="n", scope="PARENT", period="INSTANT", dim=False: (i, "F", concept, ns, value, nil, "e", scope, period, None, None, None, dim, "IDR", "Q1")
    facts = [
        fact("exact", "A", "+5.50"), fact("none", "Z"), fact("draft", "D"), fact("scope", "A", scope="CONSOLIDATED"), fact("period", "A", period="DURATION"), fact("several", "S"), fact("missing", "M"),
        fact("number", "A", "1e5"), fact("sign", "X"), fact("nil", "A", "", True), fact("zero", "N", "0.0"), fact("negated", "N", "7"), fact("namespace", "A", ns="other"), fact("dimension", "A", dim=True), fact("blank", "A", " "), fact("huge", "A", "1" * 22),
    ]
    rule = lambda i, concept, canonical="cash", sign="AS_REPORTED", status="APPROVED", version=1: (i, concept, "n", None, canonical, "PARENT", "INSTANT", sign, status, version, None)
    maps = [rule("m1", "A"), rule("m2", "D", status="DRAFT"), ("m3", "S", "n", None, "cash", None, None, "KEEP", "APPROVED", 1, None), ("m4", "S", None, None, "cash", None, None, "KEEP", "APPROVED", 1, None), rule("m5", "M", "nothing"), rule("m6", "X", sign="CUBE"), rule("m7", "N", sign="NEGATE")]
    words = [("cash", "INSTANT", "CONSOLIDATED;PARENT")]
    return spark.createDataFrame(facts, FACT), spark.createDataFrame(maps, MAP), spark.createDataFrame(words, "code string, period_type string, allowed_scope string")


def test_normalize_outcomes(spark):
    facts, maps, words = normalize_inputs(spark)
    got = {r.raw_fact_id: r for r in N.normalize(facts, N.current_mappings(maps), words).collect()}
    value = lambda i: None if got[i].value is None else float(got[i].value)
    good = {i for i, r in got.items() if r.status == "NORMALIZED"}
    assert good == {"exact", "nil", "zero", "negated", "blank"}
    assert (value("exact"), value("nil"), value("zero"), value("negated"), value("blank")) == (5.5, None, 0.0, -7.0, None)
    assert (got["nil"].availability, got["blank"].availability, got["zero"].availability) == ("NIL", "MISSING", "AVAILABLE")
    assert got["none"].status == got["namespace"].status == "UNMAPPED"
    reasons = {i: N.REASONS.index(r.reason) for i, r in got.items() if r.reason}
    assert reasons == {"none": 0, "namespace": 0, "draft": 1, "scope": 2, "period": 3, "dimension": 4, "several": 5, "missing": 6, "number": 7, "huge": 7, "sign": 8}


def test_normalization_exceptions(spark):
    facts, maps, words = normalize_inputs(spark)
    rules = [("twice@1", F.col("raw_fact_id") == "exact", (F.col("value") * 2).cast("string")), ("bad@2", F.col("raw_fact_id") == "zero", F.lit("x"))]
    got = {r.raw_fact_id: r for r in N.normalize(facts, maps, words, exceptions=rules).collect()}
    assert (float(got["exact"].value), got["exact"].exception_versions) == (11.0, "twice@1")
    assert got["zero"].status == "REVIEW_REQUIRED" and got["zero"].reason == N.REASONS[9]


def test_streams(spark, tmp_path):
    facts, maps, words = normalize_inputs(spark)
    source, out = str(tmp_path / "facts"), str(tmp_path / "out")
    for part in (facts.where("raw_fact_id < 'n'"), facts):  # the second delivery repeats the first
        part.write.mode("append").parquet(source)
        flows.normalize_stream(flows.read_stream(spark, source, FACT, 1), maps, words, out, str(tmp_path / "state")).awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == facts.count() == stored.select("record_id").distinct().count()

    runs = spark.createDataFrame([(1, "F1", "PARSE", "FAILED", "2024-01-01 00:10:00"), (2, "F1", "PARSE", "SUCCEEDED", "2024-01-01 00:20:00"), (3, "F2", "VALIDATE", "FAILED", "2024-01-03 00:00:00")], "job_run_id bigint, filing_id string, stage string, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    runs.write.parquet(str(tmp_path / "runs"))
    stream = flows.read_stream(spark, str(tmp_path / "runs"), "job_run_id bigint, filing_id string, stage string, status string, created_at timestamp")
    q = flows.failures(stream, late="1 hour").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.executions, r.failures) for r in spark.table("windows").collect()] == [(2, 1)]
    q = flows.current_state(stream).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} == {("F1", "PARSE", "SUCCEEDED"), ("F2", "VALIDATE", "FAILED")}
    keyed = stream.select(F.col("filing_id").alias("idempotency_key"), F.col("created_at").alias("discovered_at"))
    q = flows.discovered(keyed).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.idempotency_key for r in spark.table("seen").collect()) == ["F1", "F2"]


def test_redelivery_and_hash_parity(spark):
    import hashlib

    from factengine.functions import ids

    row = spark.createDataFrame([("a|b", None)], "x string, y string").select(ids.stored_id("ctx_", "x", "y").alias("s"), ids.idempotency_key("download", {"filing_id": F.col("x"), "source_locator": F.lit("u=%"), "revision_identifier": F.lit(1)}).alias("k"), ids.idempotency_key("download", {"filing_id": F.col("y"), "source_locator": F.lit("u"), "revision_identifier": F.lit(1)}).alias("n")).first()
    assert row.s == "ctx_" + hashlib.sha256(b"a|b|").hexdigest()[:24]
    assert row.k == hashlib.sha256(b"download|filing_id=a%7Cb|source_locator=u%3D%25|revision_identifier=1").hexdigest() and row.n is None
