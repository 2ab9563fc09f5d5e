"""Checks of dictionaries and mappings."""

from factengine.operators import reference_data as RD

DICTIONARY = "canonical_concept string, statement string, period_type string, sign_convention string, allowed_scope string, required string"
GOOD = ("instant", "source sign", "single;group", "optional")


def rows(spark, *made):
    return spark.createDataFrame(list(made), DICTIONARY)


def found(df):
    return sorted(((r.check, r.id) for r in df.collect()), key=lambda x: (x[0], x[1] or ""))


def test_dictionary(spark):
    fine = [(f"c{i}", s, *GOOD) for i, s in enumerate(RD.STATEMENTS * 10)]
    assert found(RD.dictionary_violations(rows(spark, *fine))) == []
    odd = rows(spark, ("a", "cash_flow", "weekly", "source sign", "group;single", "required"), (None, "other", None, None, None, None), ("b", "balance_sheet", " instant ", "source sign", "group; single; group", "required "))
    assert found(RD.dictionary_violations(odd)) == [
        ("CONCEPT_NAMELESS", None), ("DICTIONARY_TOO_SMALL", "3"), ("PERIOD_TYPE_UNKNOWN", None), ("PERIOD_TYPE_UNKNOWN", "a"), ("REQUIREDNESS_UNKNOWN", None), ("SCOPES_UNLIKE_BOTH", None), ("SIGN_CONVENTION_UNKNOWN", None), ("STATEMENT_MISSING", "income_statement"),
    ]
    assert [c for c, _ in found(RD.dictionary_violations(odd.limit(0)))] == ["DICTIONARY_TOO_SMALL"] + ["STATEMENT_MISSING"] * 3


def test_mappings(spark):
    mappings = spark.createDataFrame([("A", "n", "e1;e2", "c1", "CONFIRMED"), ("B", "n", "e1;e9", "c9", "DRAFT"), ("C", "n", None, "c1", "REJECTED"), ("C", "n", "e1", "c1", "PROPOSED")], "source_concept string, concept_namespace string, entry_point string, canonical_concept string, status string")
    dictionary = rows(spark, ("c1", "cash_flow", *GOOD))
    facts = spark.createDataFrame([("A", "n"), ("A", "n"), ("B", "other"), ("C", "n")], "source_concept string, concept_namespace string")
    points = spark.createDataFrame([("e1",), ("e2",)], "entry_point string")
    bad = RD.mapping_violations(mappings, dictionary, facts, points)
    assert found(bad) == [("MAPPING_CONCEPT_UNKNOWN", "n#B"), ("MAPPING_ENTRY_POINT_UNKNOWN", "n#B"), ("MAPPING_REPEATED", "n#C"), ("MAPPING_REPEATED", "n#C"), ("MAPPING_SOURCE_ABSENT", "n#B"), ("MAPPING_STATUS_UNKNOWN", "n#B")]
    assert {r.check: r.n for r in RD.report(bad, {"MAPPINGS": mappings}).collect()} == {"MAPPING_CONCEPT_UNKNOWN": 1, "MAPPING_ENTRY_POINT_UNKNOWN": 1, "MAPPING_REPEATED": 2, "MAPPING_SOURCE_ABSENT": 1, "MAPPING_STATUS_UNKNOWN": 1, "MAPPINGS": 4}


def test_import_plan(spark):
    kind = "k string, v string, w int"
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", None), ("c", "z", 3), ("d", None, 4), ("e", "q", 5)], kind)
    stored = spark.createDataFrame([("a", "x", 1), ("b", "y", 0), ("d", None, 4), ("e", "old", 5)], kind)
    bad = spark.createDataFrame([("P", "a"), ("O", "e"), ("P", "e"), ("P", "e")], "check string, id string")
    from pyspark.sql import functions as F

    plan = RD.import_plan(rows, stored, ["k"], ["v", "w"], bad, F.col("k"))
    assert {r.k: (r.decision, r.checks) for r in plan.collect()} == {"a": ("REFUSED", ["P"]), "b": ("NEW_VERSION", []), "c": ("NEW", []), "d": ("UNCHANGED", []), "e": ("REFUSED", ["O", "P"])}
    assert sorted(tuple(r) for r in RD.to_import(plan).collect()) == [("b", "y", None), ("c", "z", 3)] and RD.to_import(plan).columns == rows.columns
