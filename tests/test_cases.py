"""Rule cases of every rule: one that passes, one that is refused, and odd payloads."""

import json

import pytest
from pyspark.sql import functions as F

from factengine.functions import ids  # noqa: F401
from factengine.operators import audit as A, cases as CS, normalize as N

#: (rule, payload, severity), amounts of our own.
CASES = [
    ("ACC-001", {"total_assets": 5000, "total_liabilities": 3000, "total_equity": 2000}, "PASS"),
    ("ACC-001", {"total_assets": 900000, "total_liabilities": 700000, "total_equity": 150000, "temporary_syirkah_funds": 50000, "entry_point": "financesharia"}, "PASS"),
    ("ACC-001", {"total_assets": 900000, "total_liabilities": 700000, "total_equity": 150000}, "ERROR"),
    ("ACC-001", {"total_assets": 900000, "total_equity": 150000}, "ERROR"),
    ("HRY-001", {"total_equity": 100, "equity_parent": 90, "non_controlling_interests": 10}, "PASS"),
    ("HRY-001", {"total_equity": 100000, "equity_parent": 90, "non_controlling_interests": 10}, "ERROR"),
    ("HRY-002", {"total_assets": 10, "current_assets": 4, "non_current_assets": 6}, "PASS"),
    ("HRY-002", {"total_assets": 10, "entry_point": "financesharia"}, "INFO"),
    ("HRY-002", {"total_assets": 10000, "current_assets": 4, "non_current_assets": 6}, "ERROR"),
    ("HRY-003", {"total_liabilities": 10, "current_liabilities": 4, "non_current_liabilities": 6}, "PASS"),
    ("HRY-003", {"total_liabilities": 10000, "current_liabilities": 4, "non_current_liabilities": 6}, "ERROR"),
    ("HRY-004", {"revenue": 10, "cost_of_revenue": 4, "gross_profit": 6}, "PASS"),
    ("HRY-004", {"revenue": 10000, "cost_of_revenue": 4, "gross_profit": 6}, "ERROR"),
    ("HRY-005", {"profit_loss": 10, "profit_loss_parent": 9, "profit_loss_nci": 1}, "PASS"),
    ("HRY-005", {"profit_loss": 10000, "profit_loss_parent": 9, "profit_loss_nci": 1}, "ERROR"),
    ("HRY-006", {"cash_flow_operating": 5, "cash_flow_investing": -3, "cash_flow_financing": 1, "net_change_cash": 3}, "PASS"),
    ("HRY-006", {"cash_flow_operating": 5, "cash_flow_investing": -3, "cash_flow_financing": 1, "net_change_cash": 9999}, "ERROR"),
    ("CTX-001", {"period": "2024Q3", "period_type": "duration", "start_date": "2024-01-01", "end_date": "2024-09-30", "instant_date": None}, "PASS"),
    ("CTX-001", {"period": "2024Q3", "period_type": "duration", "start_date": "2024-07-01", "end_date": "2024-09-30"}, "ERROR"),
    ("CTX-001", {"period": "2024Q3", "period_type": "duration", "start_date": "2024-01-01", "end_date": "2024-06-30"}, "ERROR"),
    ("CTX-001", {"period": "2024Q3", "period_type": "instant", "instant_date": "2024-09-30"}, "PASS"),
    ("CTX-001", {"period": "2024Q3", "period_type": "instant"}, "ERROR"),
    ("CTX-001", {"period": "2024FY", "period_type": "instant", "instant_date": "2024-11-30"}, "PASS"),
    ("CTX-002", {"dict_period_type": "instant", "context_period_type": "instant"}, "PASS"),
    ("CTX-002", {"dict_period_type": "instant", "context_period_type": "duration"}, "ERROR"),
    ("CTX-003", {"is_dimensioned": False}, "PASS"),
    ("CTX-003", {"is_dimensioned": True}, "ERROR"),
    ("CTX-004", {"value_1": "5", "value_2": "5"}, "PASS"),
    ("CTX-004", {"value_1": "5"}, "PASS"),
    ("CTX-004", {"value_1": "5", "value_2": "6"}, "ERROR"),
    ("SCL-001", {"currencies_in_statement": ["IDR", "IDR"]}, "PASS"),
    ("SCL-001", {"currencies_in_statement": ["IDR", "USD"], "presentation_currency_dei": "IDR"}, "ERROR"),
    ("SCL-002", {"unit_id": "USDPerShares"}, "PASS"),
    ("SCL-002", {"unit_id": "USD"}, "ERROR"),
    ("SCL-003", {"total_assets": 1}, "PASS"),
    ("SCL-003", {"total_assets": 0}, "ERROR"),
    ("SCL-004", {"total_equity": 0}, "PASS"),
    ("SCL-004", {"total_equity": -1}, "WARN"),
    ("SCL-005", {"cash_and_cash_equivalents": 100, "ending_cash_cash_flow": 1100}, "PASS"),
    ("SCL-005", {"cash_and_cash_equivalents": 100, "ending_cash_cash_flow": 1101}, "WARN"),
    ("SCL-005", {"cash_and_cash_equivalents": 100}, "INFO"),
    ("CRX-001", {"prior_reported": 7, "comparative_in_current": 7}, "PASS"),
    ("CRX-001", {"prior_reported": 7, "comparative_in_current": 8}, "WARN"),
    ("CRX-002", {"prior_end_year_q1": 7, "prior_end_year_q2": 7}, "PASS"),
    ("CRX-002", {"prior_end_year_q1": 7, "prior_end_year_q2": 8}, "ERROR"),
    ("SCP-001", {"dei_entity_scope": "Single entity", "concept_allowed_scope": "group;single"}, "PASS"),
    ("SCP-001", {"dei_entity_scope": "Single entity", "concept_allowed_scope": "group"}, "ERROR"),
    ("SCP-001", {"dei_entity_scope": "Group entity", "concept_allowed_scope": "group"}, "PASS"),
    ("SCP-002", {"is_nil": True}, "PASS"),
    ("SCP-002", {"is_nil": True, "value_coerced_to_zero": True}, "ERROR"),
]
STATUS = {"PASS": "VERIFIED", "INFO": "VERIFIED", "WARN": "REVIEW_REQUIRED", "ERROR": "FAILED"}


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(f"T{i:02}", rule, json.dumps(body), severity, STATUS[severity]) for i, (rule, body, severity) in enumerate(CASES)]
    rows += [("X1", "NEW-001", "{}", "PASS", "VERIFIED"), ("X2", "SCL-003", "not json", "INFO", "VERIFIED"), ("X3", "SCL-003", None, "INFO", "VERIFIED"), ("X4", " SCL-003 ", '{"total_assets": "12", "other": [1]}', "PASS", "VERIFIED")]
    return spark.createDataFrame(rows, "test_case_id string, rule_code string, body string, expected_severity string, expected_status string").withColumn("payload", F.try_parse_json("body"))


def test_cases_of_all_rules(cases):
    found = {r.test_case_id: r for r in CS.judged_cases(cases).collect()}
    assert [f"{r.rule_code} {r.severity}" for i, r in sorted(found.items()) if i[0] == "T"] == [f"{rule} {severity}" for rule, _, severity in CASES]
    assert len({rule for rule, _, _ in CASES}) == 20 == len(CS.RULES)
    assert found["X1"].severity is None and found["X1"].status is None
    assert [found[x].severity for x in ("X2", "X3", "X4")] == ["INFO", "INFO", "PASS"]


def test_parity_by_rule(cases):
    counted = {r.rule_code: (r.total, r.passed, r.failed) for r in A.case_parity(CS.judged_cases(cases)).collect()}
    assert counted.pop("NEW-001") == (1, 0, 1)
    assert all(total == passed and failed == 0 for total, passed, failed in counted.values())


def test_stamping(spark):
    meta = spark.createDataFrame([("F1", "PARENT", "USD", "RESOLVED"), ("F2", "PARENT", None, "RESOLVED"), ("F3", "UNKNOWN", "USD", "REVIEW_REQUIRED")], "filing_id string, scope string, currency string, status string")
    filings = spark.createDataFrame([(f"F{i}", "CONSOLIDATED", "IDR") for i in (1, 2, 3, 4)], "filing_id string, scope string, presentation_currency string")
    got = {r.filing_id: (r.scope, r.presentation_currency) for r in N.stamped_filings(filings, meta).collect()}
    assert got == {"F1": ("PARENT", "USD"), "F2": ("PARENT", "IDR"), "F3": ("CONSOLIDATED", "IDR"), "F4": ("CONSOLIDATED", "IDR")}
    facts = spark.createDataFrame([("F1", None), ("F3", None), ("F4", "X")], "filing_id string, scope string")
    assert {r.filing_id: r.scope for r in N.stamped_facts(facts, meta).collect()} == {"F1": "PARENT", "F3": None, "F4": "X"}


def test_the_first_conflicting_group_is_named(spark, sf_dir):
    from factengine.operators import rules as R
    from factengine.plans.registry import Tables

    t = Tables(spark, sf_dir)
    one = t.v_norm.agg(F.min("filing_id")).first()[0]
    own = t.v_norm.where(F.col("filing_id") == one)
    again = own.where(F.col("canonical_concept").isin("total_assets", "revenue")).withColumns({"normalized_fact_id": F.concat("normalized_fact_id", F.lit("x")), "value": F.col("value") + 1})
    wide = R.wide_rows(t.v_filings.where(F.col("filing_id") == one), own.unionByName(again), t.v_concepts)
    row = wide.select("conflicts", "conflict_ids").first()
    assert row.conflicts == 2 and row.conflict_ids == [f"{one}-00", f"{one}-00x"]
