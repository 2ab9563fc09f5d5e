"""Names of XBRL documents, bounds of discovery, sinks, actions and details on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from factengine.functions import actions
from factengine.operators import latest, ops, publish as P, review as RV
from factengine.sources import files as FS, sinks, xbrl as X

HEAD = 'xmlns="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:cur="http://www.xbrl.org/2003/iso4217" xmlns:c="http://c" xmlns:s="http://www.w3.org/2001/XMLSchema-instance"'


def extracted(spark, body):
    return X.extract(spark.createDataFrame([("F1", f"<xbrl {HEAD}>{body}</xbrl>")], "filing_id string, document string")).cache()


def test_names_are_resolved_where_they_stand(spark):
    rows = extracted(spark, (
        '<unit id="u1"><measure>cur:IDR</measure></unit><unit id="u2"><measure xmlns:cur="http://other">cur:IDR</measure></unit><unit id="u3"><measure>shares</measure></unit><unit id="u4"><measure>lost:x</measure></unit>'
        '<context id="k"><entity><identifier scheme="s">E</identifier></entity><period><instant>2024-12-31</instant></period><scenario xmlns:c="http://inner"><d:explicitMember dimension="c:Axis">c:Gold</d:explicitMember></scenario></context>'
    ))
    units = {r.source_unit_id: (r.unit_type, r.measure, r.currency) for r in X.units(rows).collect()}
    assert units == {
        "u1": ("CURRENCY", "{http://www.xbrl.org/2003/iso4217}IDR", "IDR"), "u2": ("CUSTOM", "{http://other}IDR", None),
        "u3": ("SHARES", "{http://www.xbrl.org/2003/instance}shares", None), "u4": ("CUSTOM", "lost:x", None),
    }
    assert [(r.axis, r.axis_name, r.member_name) for r in X.dimensions(rows).collect()] == [("c:Axis", "{http://inner}Axis", "{http://inner}Gold")]


def test_document_summary(spark):
    rows = extracted(spark, (
        f'<c:{X.SCOPE_FACT} contextRef="k">Single entity</c:{X.SCOPE_FACT}><c:A contextRef="k" unitRef="IDR"> 5 </c:A><c:A contextRef="k" unitRef="IDR">5</c:A><c:A contextRef="k" unitRef="IDR">6</c:A>'
        '<c:A contextRef="j" unitRef="USD">9</c:A><c:B contextRef="k" unitRef="IDR" s:nil="true"/><c:N contextRef="k" unitRef="pure">1</c:N>'
    ))
    r = X.document_summary(rows).first()
    assert (r.scope_text, r.currency_text, r.currencies, r.nil_facts, r.conflicts) == ("Single entity", None, ["IDR", "USD"], 1, 1)
    assert {f.raw_value for f in rows.where("concept = 'A' and context_ref = 'k'").collect()} == {" 5 ", "5", "6"}


def test_appends_read_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "k int, p string, v string")
    assert [sinks.append_new(df, path, ["k"], ["p"]) for df in (rows, rows, rows.where("false"), spark.createDataFrame([(3, "b", "z"), (4, "b", "w")], rows.schema))] == [3, 0, 0, 1]
    assert spark.read.parquet(path).count() == 4


def candidate(i, **more):
    return {"filing_id": f"F{i}", "issuer_code": "abc", "period_end": "2024-03-31", "source_url": "https://a.test/x", "source_type": "pdf", "source_hash": "h", "revision_number": 1, **more}


def test_discovery_pages_and_bounds(spark, tmp_path):
    rows = [(i, json.dumps(candidate(i, **({"revision_number": 0} if i == 2 else {"issuer_code": "zz"} if i == 4 else {})))) for i in range(8)]
    df = spark.createDataFrame(rows, "n int, candidate string")
    page, bad = FS.discover(df, ["a.test"], "n", issuer=" abc ", offset=1, page_size=3)
    assert [r.n for r in page.collect()] == [1, 3, 5] and [r.n for r in bad.collect()] == [2]
    for wrong in ({"page_size": 0}, {"page_size": 1001}, {"offset": -1}, {"issuer": "a b"}):
        with pytest.raises(ValueError):
            FS.discover(df, ["a.test"], "n", **wrong)
    for name, text in {"ok": "[{}, {}]", "wrapped": '{"candidates": [{}]}', "broken": "[", "other": "5", "many": json.dumps([{}] * 4), "long": "[" + " " * 500 + "]"}.items():
        (tmp_path / name).write_text(text)
    found = {r.path.rsplit("/", 1)[1]: r.problem for r in FS.candidate_files(spark, str(tmp_path), 400, 3).collect()}
    assert found == {"ok": None, "wrapped": None, "broken": "not JSON", "other": "no candidate list", "many": "too many candidates", "long": "too many bytes"}


def test_actions(spark):
    df = spark.createDataFrame([("a", "M1", "APPROVED"), (None, None, "UNMAPPED"), ("a", "M1", "DRAFT")], "path string, rule string, status string")
    c = F.col
    got = [tuple(x) for x in df.select(*[v.alias(k) for k, v in {**actions.of_series(c("rule"), c("status")), **actions.of_fact(c("path"), c("rule"))}.items()]).collect()]
    ok = (True, None)
    assert got[0] == (ok, ok, ok, ok, ok)
    assert got[1] == (ok, (False, "UNMAPPED_SERIES"), (False, "MAPPING_NOT_APPROVED"), (False, "EVIDENCE_NOT_AVAILABLE"), (False, "MAPPING_NOT_AVAILABLE"))
    assert got[2][2] == (False, "MAPPING_NOT_APPROVED")


def test_details_keep_rows_without_partners(spark):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    facts = spark.createDataFrame([("r1", "F1", None, None)], "raw_fact_id string, filing_id string, canonical_concept string, mapping_rule_id string")
    raw = empty("raw_fact_id string, context_id string, unit_id string, source_concept string, source_namespace string, raw_value string, is_nil boolean")
    out = RV.fact_detail(facts, empty("filing_id string"), raw, empty("context_id string"), empty("unit_id string"), empty("mapping_rule_id string"), empty("code string")).collect()
    assert len(out) == 1 and out[0].raw_fact is out[0].context is out[0].unit is out[0].filing is out[0].mapping is out[0].concept is None
    runs = empty("filing_id string, run_id bigint, job_run_id bigint, stage string, status string, attempt bigint, error_message string")
    one = ops.detail(spark.createDataFrame([("F1",)], "filing_id string"), runs, empty("filing_id string, source_hash string, artifact_type string, size_bytes bigint")).first()
    assert one.filing_id == "F1" and one.run_id is one.attempts is one.artifacts is None
    page = latest.page_with_total(spark.range(60).toDF("n"), [F.asc("n")], 2, 50)
    assert [(r.n, r.total) for r in page.collect()] == [(n, 60) for n in range(50, 60)]


def test_document_codes_come_in_order(spark):
    """Each change breaks one more condition; the first broken one is reported."""
    fact = "named_struct('normalized_fact_id', 'n1', 'raw_fact_id', 'r1', 'canonical_concept', 'assets', 'value', '5.0')"
    good = {
        "snapshot_id": "'S1'", "contract": f"'{P.CONTRACT}'", "contract_version": f"'{P.CONTRACT_VERSION}'", "filing": "named_struct('filing_id', 'F1', 'revision_number', 1)",
        "quality": "named_struct('status', 'VERIFIED', 'normalized_dataset_version', 'd', 'validation_rule_set_version', 'r')", "source": "named_struct('source_url', 'https://a.test/x', 'source_hash', 'h', 'storage_reference', 'a/b')",
        "facts": f"array({fact})", "lineage": "named_struct('raw_fact_ids', array('r1'), 'normalized_fact_ids', array('n1'), 'validation_result_ids', array('v'), 'mapping_versions', array('1'), 'normalization_version', 'v1')",
        "limitations": "array(named_struct('code', 'C', 'references', array('n1'), 'severity', 'WARN', 'message', 'm'))", "unmapped": "array(named_struct('source_concept', 'c', 'source_reference', 'r', 'reason', 'w'))",
    }
    code = lambda **changes: spark.range(1).selectExpr(*[f"{v} as {k}" for k, v in {**good, **changes}.items()]).select(P.document_code().alias("c")).first().c
    changes = [
        ("UNMAPPED_CANONICAL_FACT", "facts", f"array({fact.replace('assets', 'UNMAPPED')})"), ("MALFORMED_SNAPSHOT", "contract", "'other'"), ("INVALID_LIMITATION", "limitations", good["limitations"].replace("WARN", "ERROR")),
        ("MISSING_FACT_LINEAGE", "lineage", good["lineage"].replace("array('v')", "array()")), ("INVALID_DECIMAL_STRING", "facts", f"array({fact.replace('5.0', '05')})"), ("UNSAFE_STORAGE_REFERENCE", "source", good["source"].replace("a/b", "/a")),
        ("MISSING_SOURCE_PROVENANCE", "source", good["source"].replace("'h'", "cast(null as string)").replace("a/b", "/a")), ("NON_VERIFIED_SNAPSHOT", "quality", good["quality"].replace("VERIFIED", "PENDING")), ("MISSING_SNAPSHOT_ID", "snapshot_id", "' '"),
    ]
    assert code() is None and {c for c, _, _ in changes} == set(P.CODES)
    so_far = {}
    for want, column, value in changes:
        so_far[column] = value
        assert code(**so_far) == want
