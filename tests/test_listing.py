"""Listings of snapshots and series, disclosures, times with offsets."""

import datetime
import json

from pyspark.sql import functions as F

from factengine.functions import scalars as S
from factengine.operators import listing as L, normalize as N, publish as P

D = datetime.datetime


def snapshots(spark):
    def payload(issuer, year, status="VERIFIED", **more):
        return json.dumps({"quality": {"status": status}, "filing": {"issuer_code": issuer, "fiscal_year": year, "fiscal_period": "Q1", **more}})

    rows = [(f"S{i:02}", f"F{i}", D(2024, 1, 1 + i % 20), payload("AAA", 2024)) for i in range(30)]
    rows += [("S90", "F0", D(2024, 2, 1), payload("AAA", 2025)), ("S91", "F91", D(2024, 1, 1), payload("BBB", 2024)), ("S92", "F92", D(2024, 1, 1), payload("BBB", 2024, "FAILED"))]
    rows += [("S93", "F93", D(2024, 1, 2), payload("BBB", "no year", revision_number=2)), ("S94", "F94", None, "{}"), ("S95", "F95", D(2024, 1, 1), None)]
    return spark.createDataFrame(rows, "snapshot_id string, filing_id string, published_at timestamp, text string").select("snapshot_id", "filing_id", "published_at", F.parse_json("text").alias("payload"))


def test_stored_listing(spark):
    got = L.stored_listing(snapshots(spark)).collect()
    own = sorted((r for r in got if r.issuer_code == "AAA"), key=lambda r: r.place)
    assert [r.place for r in own] == list(range(1, 31)) and [r.page for r in own] == [1] * 25 + [2] * 5
    assert own[0].snapshot_id == "S90" and "S00" not in {r.snapshot_id for r in own}  # of a filing the newest counts
    keys = [(r.published_at, r.snapshot_id) for r in own]
    assert keys == sorted(keys, reverse=True)
    assert [(r.snapshot_id, r.fiscal_year, r.revision_number) for r in got if r.issuer_code == "BBB" and r.place == 1] == [("S93", None, 2)]
    some = L.stored_listing(snapshots(spark), {"$.filing.fiscal_year": ("bigint", 2024), "$.filing.issuer_code": ("string", "AAA")}, F.lit(D(2024, 1, 18)), size=5).collect()
    assert {r.snapshot_id for r in some} == {"S18", "S19"} and L.stored_listing(snapshots(spark).limit(0)).collect() == []


def test_inventory_list(spark):
    rows = [("k1", "Assets", None, "APPROVED", "total_assets"), ("k2", "Assets", "general", "DRAFT", None), ("k3", "Cash", "general", "UNMAPPED", None)]
    inventory = spark.createDataFrame(rows, "series_key string, source_concept string, entry_point string, display_status string, canonical_concept string")
    listed = lambda **k: [r.series_key for r in sorted(L.inventory_list(inventory, **k).collect(), key=lambda r: r.place)]
    assert listed() == ["k1", "k2", "k3"] and listed(search=" TOTAL_ ") == ["k1"] and listed(search="unmapped") == ["k3"]
    assert listed(status="DRAFT") == ["k2"] and listed(entry_point="general") == ["k2", "k3"] and listed(search="x") == []


def test_disclosures(spark):
    results = spark.createDataFrame([("F1", "A-1", 1, "SKIPPED", "INFO", "m", ["b", "a", "a"]), ("F1", "A-2", 1, "FAIL", "ERROR", "m", []), ("F1", "A-3", 1, "PASS", "INFO", "m", [])], "filing_id string, rule_code string, rule_version int, result string, severity string, message string, evidence array<string>")
    facts = spark.createDataFrame([("F1", "n1", "NIL"), ("F1", "n2", "AVAILABLE")], "filing_id string, normalized_fact_id string, availability string")
    outcomes = spark.createDataFrame([("F2", "C", "r1", "UNMAPPED", "NO_MAPPING"), ("F2", "C", "r1", "UNMAPPED", "NO_MAPPING"), ("F2", "D", "r2", "NORMALIZED", None)], "filing_id string, source_concept string, raw_fact_id string, status string, reason string")
    got = {r.filing_id: r for r in P.disclosures(results, facts, outcomes).collect()}
    assert [i.code for i in got["F1"]["items"]] == ["AVAILABILITY_NIL", "VALIDATION_A-1"] and got["F1"]["unmapped"] == []
    references = got["F1"]["items"][1].references
    assert len(references) == 3 and references[:2] == ["a", "b"] and references[2].startswith("vr_")
    assert got["F2"]["items"] == [] and [tuple(u) for u in got["F2"]["unmapped"]] == [("C", "r1", "NO_MAPPING")]


def test_times_with_offsets(spark):
    texts = {"2024-02-29T23:30:00+07:00": "2024-02-29T16:30:00+00:00", "2024-02-29 23:30-0130": "2024-03-01T01:00:00+00:00", "2024-02-29T23:30:00.25Z": "2024-02-29T23:30:00+00:00", "2024-02-30T00:00:00Z": None, "2024-02-29T23:30:00": None, "": None, "now+07:00": None}
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert {r.t: r.u for r in rows.select("t", S.utc_of_text(F.col("t")).alias("u")).collect()} == {**texts, None: None}


def test_exceptions_read_the_value_before_them(spark, sf_dir):
    from factengine.plans.registry import Tables

    t = Tables(spark, sf_dir)
    value = F.col("value")
    double = ("TWICE@1", value > 10, (value * 2).cast("string"))
    text = ("TEXT@2", value > 1000, F.lit("n/a"))
    plain = {r.raw_fact_id: r for r in N.normalize(t.v_full, t.v_current, t.v_concepts).where("status = 'NORMALIZED'").select("raw_fact_id", "value").collect()}
    got = {r.raw_fact_id: r for r in N.normalize(t.v_full, t.v_current, t.v_concepts, exceptions=[double, text]).collect()}
    assert len(plain) > 100
    for i, r in plain.items():
        now = r.value * 2 if r.value is not None and r.value > 10 else r.value
        if now is not None and now > 1000:
            assert (got[i].status, got[i].reason, got[i].value) == ("REVIEW_REQUIRED", "BAD_EXCEPTION_VALUE", None)
        else:
            assert got[i].value == now and got[i].exception_versions == ("TWICE@1" if now != r.value else "NONE")
