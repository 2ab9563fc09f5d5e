"""Rule cases: payloads of any shape, judged by the rules themselves, against what their table expects.

A payload is a VARIANT, from which the columns of a wide row are read; a case is
judged by its rule over that row, in batch mode. So cases of all rules lie in one
table and one projection, whatever fields they have. Fields that a payload lacks
are null.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from . import audit as A, rules as R

FACTS = "array<struct<normalized_fact_id:string,canonical_concept:string>>"


def _field(path: str, kind: str) -> Column:
    return F.try_variant_get("payload", f"$.{path}", kind)


def _comparative(mode: str) -> Column:
    same = F.col("prior_reported").eqNullSafe(F.col("comparative"))
    return F.when(same, R.passed("The comparative is what was reported.")).otherwise(R.review("The comparative was restated."))


def _opening(mode: str) -> Column:
    same = F.col("opening_first").eqNullSafe(F.col("opening_second"))
    return F.when(same, R.passed("Opening balances agree.")).otherwise(R.failed("Opening balances differ."))


#: The readings of the audit: its own CTX-001, CRX-001 and CRX-002, the rules' batch mode for all others.
RULES = {**R.RULES, "CTX-001": A.QUARTERLY, "CRX-001": R.Rule("CRX-001", _comparative), "CRX-002": R.Rule("CRX-002", _opening)}


def wide_cases(cases: DataFrame) -> DataFrame:
    """cases (test_case_id, rule_code, payload) with the columns that rules read."""
    c, this = F.col, F.col("test_case_id")
    text = lambda path: _field(path, "string")
    named = lambda cond: F.when(F.coalesce(cond, F.lit(False)), this)
    due = S.quarter_end(F.upper(F.substring(text("period"), -2, 2)))
    lasting = F.coalesce(F.lower(text("period_type")) == "duration", F.lit(False))
    instant = F.coalesce(F.lower(text("period_type")) == "instant", F.lit(False))
    ends = lambda d: d.isNull() | (d == "") | (due.isNotNull() & ~d.endswith(due))
    starts = F.coalesce(text("start_date").endswith("-01-01"), F.lit(False))
    single = F.lower(F.coalesce(text("dei_entity_scope"), F.lit(""))).contains("single")
    numbers = {concept: _field(concept, R.DECIMAL) for concept in R.CONCEPTS}
    found = {
        **numbers,
        "entry_point": text("entry_point"), "owned": F.array().cast(FACTS), "presentation_currency": text("presentation_currency_dei"),
        "bad_quarter": named((lasting & (~starts | ends(text("end_date")))) | (instant & ends(text("instant_date")))),
        "bad_period_type": named(~F.lower(text("dict_period_type")).eqNullSafe(F.lower(text("context_period_type")))),
        "bad_dimension": named(_field("is_dimensioned", "boolean")),
        "conflicts": F.when((text("value_1") != "") & (text("value_2") != "") & (text("value_1") != text("value_2")), 1).otherwise(0),
        "conflict_ids": F.array(this),
        "currencies": F.array_distinct(F.coalesce(_field("currencies_in_statement", "array<string>"), F.array().cast("array<string>"))),
        "bad_unit": named(~F.coalesce(text("unit_id").contains("PerShares"), F.lit(False))),
        "prior_reported": _field("prior_reported", R.DECIMAL), "comparative": _field("comparative_in_current", R.DECIMAL),
        "opening_first": _field("prior_end_year_q1", R.DECIMAL), "opening_second": _field("prior_end_year_q2", R.DECIMAL),
        "scopes": F.array(F.lit("GIVEN")), "bad_scope": named(single & ~F.array_contains(F.split(F.coalesce(text("concept_allowed_scope"), F.lit("")), ";"), "single")),
        "zero_issue": F.coalesce(_field("value_coerced_to_zero", "boolean"), F.lit(False)), "bad_nil": F.lit(None).cast("string"),
    }
    return cases.withColumns(found).withColumn("rule_code", F.trim(c("rule_code")))


def judged_cases(cases: DataFrame) -> DataFrame:
    """cases (test_case_id, rule_code, payload, expected_severity, expected_status) with severity and status found; null severity for a code without a rule."""
    wide = wide_cases(cases)
    found = F.lit(None)
    for code, rule in RULES.items():  # one evaluated per case
        found = F.when(F.col("rule_code") == code, rule.evaluate("batch")).otherwise(found)
    result = found.cast(R.RESULT)["result"]
    severity = F.when(result == "PASS", "PASS").when(result == "SKIPPED", "INFO").when(result == "FAIL", "ERROR").when(result == "REVIEW_REQUIRED", "WARN")
    out = wide.withColumn("severity", severity)
    return out.select("test_case_id", "rule_code", "expected_severity", "expected_status", "severity", F.when(F.col("severity").isNotNull(), A.severity_status(F.col("severity"))).alias("status"))
