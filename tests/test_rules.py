"""Each rule on hand-made filings, in both modes."""

import pytest
from pyspark.sql import functions as F

from factengine.operators import quality, rules as R

DEC = "decimal(36,18)"
EXTRA = "entry_point string, presentation_currency string, superseded string, superseded_known boolean, bad_dates string, bad_period_type string, bad_dimension string, bad_unit string, bad_scope string, bad_nil string, currencies array<string>, scopes array<string>, conflicts int, conflict_ids array<string>, changed_ids array<string>, prior_period string, prior_filing string, overlap_ids array<string>, zero_issue boolean, owned array<struct<normalized_fact_id:string,canonical_concept:string>>"
BASE = {"entry_point": "x/general", "presentation_currency": "IDR", "superseded_known": False, "currencies": ["IDR"], "scopes": ["PARENT"], "conflicts": 0, "conflict_ids": [], "changed_ids": [], "overlap_ids": [], "zero_issue": False, "owned": []}
#: (rule, mode, inputs, result)
CASES = [
    ("ACC-001", "batch", dict(total_assets=100_000, total_liabilities=60_000, total_equity=40_000), "PASS"),
    ("ACC-001", "batch", dict(total_assets=100_000, total_liabilities=60_000, total_equity=30_000), "FAIL"),
    ("ACC-001", "batch", dict(total_assets=100_000), "FAIL"),
    ("ACC-001", "service", dict(total_assets=100_000), "SKIPPED"),
    ("ACC-001", "service", dict(total_assets=101_000, total_liabilities=60_000, total_equity=40_000), "PASS"),
    ("ACC-001", "service", dict(total_assets="101000.000000000000000001", total_liabilities=60_000, total_equity=40_000), "FAIL"),
    ("ACC-001", "service", dict(total_assets=150_000, total_liabilities=60_000, total_equity=40_000, temporary_syirkah_funds=50_000, entry_point="x/financesharia"), "PASS"),
    ("ACC-001", "service", dict(total_assets=150_000, total_liabilities=60_000, total_equity=40_000, temporary_syirkah_funds=50_000), "FAIL"),
    ("HRY-001", "batch", dict(total_equity=9_000, non_controlling_interests=9_000), "SKIPPED"),
    ("HRY-001", "service", dict(total_equity=9_000, non_controlling_interests=9_000), "PASS"),
    ("HRY-001", "batch", dict(total_equity=9_000, equity_parent=3_000, non_controlling_interests=1_000), "FAIL"),
    ("HRY-002", "batch", dict(total_assets=9_000, entry_point="finance"), "SKIPPED"),
    ("HRY-002", "batch", dict(total_assets=9_000, current_assets=5_000, non_current_assets=4_000), "PASS"),
    ("HRY-002", "batch", dict(total_assets=9_000, current_assets=1_000, non_current_assets=4_000), "FAIL"),
    ("HRY-003", "batch", dict(total_liabilities=9_000, current_liabilities=1_000, non_current_liabilities=4_000), "FAIL"),
    ("HRY-004", "batch", dict(revenue=9_000, cost_of_revenue=4_000, gross_profit=5_000), "PASS"),
    ("HRY-004", "batch", dict(revenue=9_000, cost_of_revenue=4_000, gross_profit=1_000), "FAIL"),
    ("HRY-004", "service", dict(revenue=9_000, cost_of_revenue=4_000, gross_profit=1_000, entry_point="x/infrastructure"), "SKIPPED"),
    ("HRY-005", "batch", dict(profit_loss=9_000, profit_loss_parent=8_000, profit_loss_nci=1_000), "PASS"),
    ("HRY-005", "batch", dict(profit_loss=9_000, profit_loss_parent=1_000, profit_loss_nci=1_000), "FAIL"),
    ("HRY-006", "batch", dict(cash_flow_operating=-5_000, cash_flow_investing=9_000, cash_flow_financing=1_000, net_change_cash=5_000), "PASS"),
    ("HRY-006", "batch", dict(cash_flow_operating=-5_000, cash_flow_investing=9_000, cash_flow_financing=1_000, net_change_cash=15_000), "FAIL"),
    ("HRY-006", "batch", dict(cash_flow_operating=-5_000, net_change_cash=-5_000), "SKIPPED"),
    ("CTX-001", "service", dict(bad_dates="f1"), "FAIL"),
    ("CTX-002", "service", {}, "PASS"),
    ("CTX-003", "service", dict(bad_dimension="f1"), "FAIL"),
    ("CTX-004", "service", dict(conflicts=1, conflict_ids=["a", "b"]), "FAIL"),
    ("SCL-001", "service", dict(currencies=["IDR", "USD"]), "FAIL"),
    ("SCL-001", "service", dict(currencies=["USD"]), "FAIL"),
    ("SCL-001", "service", dict(currencies=["USD"], presentation_currency="usd"), "PASS"),
    ("SCL-002", "service", dict(bad_unit="f9"), "FAIL"),
    ("SCL-003", "service", dict(total_assets=-5), "FAIL"),
    ("SCL-003", "service", {}, "SKIPPED"),
    ("SCL-004", "service", dict(total_equity=-5), "REVIEW_REQUIRED"),
    ("SCL-005", "service", dict(cash_and_cash_equivalents=5, ending_cash_cash_flow=6), "REVIEW_REQUIRED"),
    ("SCL-005", "batch", dict(cash_and_cash_equivalents=5, ending_cash_cash_flow=6), "PASS"),
    ("CRX-001", "service", dict(superseded="F0"), "REVIEW_REQUIRED"),
    ("CRX-001", "service", dict(superseded="F0", superseded_known=True), "PASS"),
    ("CRX-001", "service", dict(superseded="F0", superseded_known=True, changed_ids=["f1"]), "REVIEW_REQUIRED"),
    ("CRX-002", "service", dict(prior_period="Q1"), "REVIEW_REQUIRED"),
    ("CRX-002", "service", dict(prior_period="Q1", prior_filing="F0"), "SKIPPED"),
    ("CRX-002", "service", dict(prior_period="Q1", prior_filing="F0", overlap_ids=["f1"]), "PASS"),
    ("SCP-001", "service", dict(scopes=[]), "FAIL"),
    ("SCP-001", "service", dict(bad_scope="f1"), "FAIL"),
    ("SCP-001", "service", {}, "PASS"),
    ("SCP-002", "service", dict(bad_nil="f1"), "FAIL"),
    ("SCP-002", "service", dict(zero_issue=True), "FAIL"),
]


def test_every_rule_has_a_case():
    assert {c[0] for c in CASES} == set(R.RULES)


@pytest.mark.parametrize("mode", ["service", "batch"])
def test_rules(spark, mode):
    cases = [c for c in CASES if c[1] == mode]
    names = [c for c in R.CONCEPTS]
    schema = "filing_id string, " + ", ".join(f"{c} string" for c in names) + ", " + EXTRA
    columns = ["filing_id", *names, *(x.split()[0] for x in EXTRA.split(", ") if " " in x)]
    data = [[str(i), *[None if (v := inputs.get(c)) is None else str(v) for c in names], *[{**BASE, **inputs}.get(c) for c in columns[1 + len(names) :]]] for i, (_, _, inputs, _) in enumerate(cases)]
    wide = spark.createDataFrame(data, schema).withColumns({c: F.col(c).cast(DEC) for c in names})
    got = {(r.filing_id, r.rule_code): r for r in R.evaluate(wide, mode=mode).collect()}
    for i, (code, _, inputs, want) in enumerate(cases):
        r = got[str(i), code]
        assert r.result == want, (code, inputs)
        assert r.severity == {"PASS": "INFO", "SKIPPED": "INFO", "FAIL": "ERROR", "REVIEW_REQUIRED": "WARN"}[want]


def test_configured_severity_and_floor(spark):
    results = spark.createDataFrame([("a", "FAIL", "WARN"), ("a", "PASS", "INFO"), ("b", "PASS", "INFO"), ("c", "FAIL", "ERROR")], "filing_id string, result string, severity string")
    floor = spark.createDataFrame([("b", "REVIEW_REQUIRED"), ("c", "REVIEW_REQUIRED")], "filing_id string, floor string")
    assert dict(quality.filing_status(results, floor).collect()) == {"a": "REVIEW_REQUIRED", "b": "REVIEW_REQUIRED", "c": "FAILED"}


def test_registry_refuses_other_versions():
    assert list(R.registry({"ACC-001": 1})) == ["ACC-001"]
    for stored in ({"ACC-001": 2}, {"NEW-001": 1}):
        with pytest.raises(LookupError):
            R.registry(stored)
