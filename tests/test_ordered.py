"""Mapping versions asked for one after another, against a plain loop."""

import random

import pytest

from factengine.functions import ids
from factengine.operators import ordered as OR
from pyspark.sql import functions as F

REQUESTS = "request_id string, place bigint, source_namespace string, source_concept string, entry_point string, expected_version bigint, evidence_ids array<string>, wrong boolean"
MAPPINGS = "mapping_rule_id string, source_namespace string, source_concept string, entry_point string, rule_version bigint"


def keyed(df):
    return df.withColumn("series_key", ids.series_key(F.col("source_namespace"), F.col("source_concept"), F.col("entry_point")))


@pytest.mark.parametrize("block", [4, 1000])
def test_versions_in_order(spark, block):
    rng = random.Random(block)
    mappings = [("M1", "n", "A", "e", 3), ("M0", "n", "A", "e", 2), ("M2", None, "B", "e", 1)]
    owners = {"E1": "A", "E2": "B", "E3": None}
    asked = []
    for i in range(300):
        concept = rng.choice("AAAB") if i % 10 else "C"
        top = {"A": 3, "B": 1, "C": None}[concept]
        expected = rng.choice([top, top + i // 30, top + 1]) if top else rng.choice([None, 0, i // 100])
        some = rng.choice([[], ["E3"], ["E1", "E1"], ["E2"], ["E9", "E1"]])
        asked.append((f"R{i:03}", i // 2, "n" if concept == "A" else None, concept, "e", expected, some, rng.random() < 0.1))
    requests = keyed(spark.createDataFrame(asked, REQUESTS))
    requests = requests.withColumn("source_concept", F.when(F.col("wrong"), "Z").otherwise(F.col("source_concept"))).drop("wrong")
    found = OR.versions_in_order(requests, keyed(spark.createDataFrame(mappings, MAPPINGS)), spark.createDataFrame(list(owners.items()), "evidence_id string, source_concept string"), block)
    got = {r.request_id: (r.code, r.rule_version, r.supersedes) for r in found.collect()}

    now, want = {"A": (3, "M1"), "B": (1, "M2"), "C": (0, None)}, {}
    for name, _, _, concept, _, expected, some, wrong in sorted(asked, key=lambda r: (r[1], r[0])):
        version, before = now[concept]
        if wrong:
            code = OR.CODES[0]
        elif (expected or 0) != version:
            code = OR.CODES[1]
        elif any(e not in owners for e in some):
            code = OR.CODES[2]
        else:
            code = OR.CODES[3] if any(owners[e] not in (None, concept) for e in some) else None
        want[name] = (code, None, None) if code else (None, version + 1, before)
        if code is None:
            now[concept] = (version + 1, f"MAP-{name}")
    assert got == want
    assert sum(c is None for c, _, _ in want.values()) > 5 and {c for c, _, _ in want.values()} >= set(OR.CODES)
    audit = OR.version_audit(found).collect()
    assert len(audit) == sum(c is None for c, _, _ in want.values())
    assert sum(r.old_value is None for r in audit) == (now["C"][0] > 0)


def test_no_requests(spark):
    none = keyed(spark.createDataFrame([], REQUESTS)).drop("wrong")
    assert OR.versions_in_order(none, keyed(spark.createDataFrame([("M1", "n", "A", "e", 3)], MAPPINGS)), spark.createDataFrame([], "evidence_id string, source_concept string")).collect() == []


def test_numbers_in_the_whole_order(spark):
    from factengine.operators.latest import numbered

    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "cast(nullif(id % 40, 3) as int) as k")
    got = numbered(rows, [F.desc_nulls_last("k"), F.asc("id")], "place").collect()
    want = sorted(rows.collect(), key=lambda r: (r.k is None, -(r.k or 0), r.id))
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [r.id for r in want]
    assert sorted(r.place for r in got) == list(range(1, 5001))
    assert numbered(rows.limit(0), [F.asc("id")], "place").collect() == []
