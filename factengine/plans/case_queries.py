"""A table of rule cases, stamped facts, and issues that rules read."""

from pyspark.sql import functions as F

from ..operators import audit as A, cases as CS, normalize as N, rules as R
from ..sources import files as FS
from .norm_queries import VIEWS as NORM_VIEWS
from .ops_queries import as_csv
from .projection import RULE_CODES, VIEWS
from .registry import query

C = F.col

WARNS = ("SCL-004", "SCL-005", "CRX-001")


def payload(code: str, x, bad):
    """A payload for a rule with amounts of the filing, one that passes or one that the rule refuses."""
    either = lambda a, b: F.when(bad, b).otherwise(a)
    lit, off = F.lit, F.when(bad, 5000).otherwise(1)
    if code in ("ACC-001", "HRY-001", "HRY-002", "HRY-003", "HRY-004", "HRY-005"):
        whole, one, two = {
            "ACC-001": ("total_assets", "total_liabilities", "total_equity"), "HRY-001": ("total_equity", "equity_parent", "non_controlling_interests"), "HRY-002": ("total_assets", "current_assets", "non_current_assets"),
            "HRY-003": ("total_liabilities", "current_liabilities", "non_current_liabilities"), "HRY-004": ("revenue", "cost_of_revenue", "gross_profit"), "HRY-005": ("profit_loss", "profit_loss_parent", "profit_loss_nci"),
        }[code]
        return F.struct((x + off).alias(whole), (x - 7).alias(one), lit(7).alias(two), lit("general").alias("entry_point"))
    return {
        "HRY-006": F.struct(x.alias("cash_flow_operating"), (-x).alias("cash_flow_investing"), lit(9).alias("cash_flow_financing"), (lit(9) + off).alias("net_change_cash")),
        "CTX-001": F.struct(lit("2026Q2").alias("period"), lit("duration").alias("period_type"), either(lit("2026-01-01"), lit("2026-03-01")).alias("start_date"), lit("2026-06-30").alias("end_date")),
        "CTX-002": F.struct(lit("instant").alias("dict_period_type"), either(lit("instant"), lit("duration")).alias("context_period_type")),
        "CTX-003": F.struct(lit("total_equity").alias("canonical_concept"), bad.alias("is_dimensioned")),
        "CTX-004": F.struct(x.cast("string").alias("value_1"), either(x, x + 1).cast("string").alias("value_2")),
        "SCL-001": F.struct(either(F.array(lit("IDR")), F.array(lit("IDR"), lit("USD"))).alias("currencies_in_statement")),
        "SCL-002": F.struct(lit("eps_basic_continuing").alias("concept"), either(lit("IDRPerShares"), lit("IDR")).alias("unit_id")),
        "SCL-003": F.struct(either(x, -x).alias("total_assets")),
        "SCL-004": F.struct(either(x, -x).alias("total_equity")),
        "SCL-005": F.struct(x.alias("cash_and_cash_equivalents"), (x + off).alias("ending_cash_cash_flow")),
        "CRX-001": F.struct(x.alias("prior_reported"), either(x, x + 1).alias("comparative_in_current")),
        "CRX-002": F.struct(x.alias("prior_end_year_q1"), either(x, x + 1).alias("prior_end_year_q2")),
        "SCP-001": F.struct(lit("Single entity").alias("dei_entity_scope"), either(lit("group;single"), lit("group")).alias("concept_allowed_scope")),
        "SCP-002": F.struct(bad.alias("is_nil"), bad.alias("value_coerced_to_zero")),
    }[code]


def case_rows(t):
    """A case for each order: its rule and whether it is to be refused follow from the order's number; every 97th expects the wrong thing."""
    k = C("o_orderkey")
    bad, x = F.floor(k / 20) % 2 == 1, F.floor("o_totalprice").cast("bigint") + 1
    code = F.element_at(F.array(*map(F.lit, RULE_CODES)), (k % 20 + 1).cast("int"))
    text = F.lit(None).cast("string")
    for name in RULE_CODES:
        text = F.when(code == name, F.to_json(payload(name, x, bad))).otherwise(text)
    severity = F.when(bad != (k % 97 == 0), F.when(code.isin(*WARNS), "WARN").otherwise("ERROR")).otherwise("PASS")
    columns = {"test_case_id": F.concat(F.lit("TC-"), "o_orderkey"), "rule_code": code, "input_mock_json": text, "expected_severity": severity, "expected_status": A.severity_status(severity)}
    return t.orders.select(*[columns.get(c, F.lit("x")).alias(c) for c in FS.CASES])


def read_case_table(t):
    rows = FS.read_csv(t.spark, as_csv(case_rows(t), "cases"), FS.CASES)
    return rows.withColumn("payload", F.try_parse_json("input_mock_json"))


@query("a24_case_table", f"""
    select ({RULE_CODES})[1 + o_orderkey % 20] as rule_code, count(*) as total, cast(sum(case when o_orderkey % 97 = 0 then 0 else 1 end) as bigint) as passed, cast(sum(case when o_orderkey % 97 = 0 then 1 else 0 end) as bigint) as failed
    from orders group by 1
""")
def a24(t):
    """Cases of all twenty rules, read from a table with what is expected of each."""
    return A.case_parity(CS.judged_cases(read_case_table(t)))


def _stamped(sql: str) -> str:
    for name in ("v_full", "v_cand", "v_outcomes"):
        sql = sql.replace(name, name.replace("v_", "v_stamped_"))
    return sql


_METADATA = """
    with picks as (select filing_id, arg_min(raw_value, (source_context_id <> 'CurrentYearInstant', raw_fact_id)) filter (where source_namespace like '%/dei' and source_concept like 'Whether%') as s,
        arg_min(raw_value, (source_context_id <> 'CurrentYearInstant', raw_fact_id)) filter (where source_namespace like '%/dei' and source_concept like 'Desc%') as p, list_distinct(list(upper(unit_currency)) filter (where unit_currency is not null)) as units from v_dei group by filing_id)
    select filing_id, scope, currency from (select filing_id, units, case when s like '%Group%' then 'CONSOLIDATED' when s like '%tunggal%' then 'PARENT' else 'UNKNOWN' end as scope, case when p like '%Dollar%' then 'USD' when p like '%IDR%' then 'IDR' end as currency from picks)
    where scope <> 'UNKNOWN' and not (currency is not null and len(list_filter(coalesce(units, []), lambda u: u <> currency)) > 0)
"""
VIEWS |= {
    "v_metadata": (lambda t: N.resolve_metadata(t.v_dei), _METADATA),
    "v_stamped_full": (lambda t: N.stamped_facts(t.v_full, t.v_metadata), "select r.* replace (coalesce(m.scope, r.scope) as scope) from v_full r left join v_metadata m on m.filing_id = r.filing_id"),
    "v_stamped_cand": (None, _stamped(NORM_VIEWS["v_cand"][1])),
    "v_stamped_outcomes": (lambda t: N.normalize(t.v_stamped_full, t.v_current, t.v_concepts), _stamped(NORM_VIEWS["v_outcomes"][1])),
}


@query("c38_stamped_normalize", "select raw_fact_id, status, coalesce(reason, '') as reason, case when reason is null then scope end as scope from v_stamped_outcomes")
def c38(t):
    """Facts normalized under the scope that their filing's own metadata give, where these are resolved."""
    return t.v_stamped_outcomes.select("raw_fact_id", "status", F.coalesce("reason", F.lit("")).alias("reason"), "scope")


@query("c39_stamped_filings", "select f.filing_id, coalesce(m.currency, f.presentation_currency) as presentation_currency, case when m.filing_id is not null then m.scope else f.scope end as scope from v_filings f left join v_metadata m on m.filing_id = f.filing_id")
def c39(t):
    return N.stamped_filings(t.v_filings, t.v_metadata).select("filing_id", "presentation_currency", "scope")


@query("r23_zero_issues", """
    select f.filing_id, case when f.o_orderkey % 13 = 0 and n.nils > 0 then 'FAIL' when w.bad_nil is not null then 'FAIL' else 'PASS' end as result
    from v_filings f join v_wide w on w.filing_id = f.filing_id left join (select filing_id, count(*) as nils from v_norm where is_nil group by filing_id) n on n.filing_id = f.filing_id
""")
def r23(t):
    """Nil facts of every 13th filing were stored as zero; the issues found in the store reach the rule."""
    tampered = F.col("is_nil") & (F.substring("filing_id", 2, 20).cast("bigint") % 13 == 0)
    kept = t.v_norm.withColumn("value", F.when(tampered, F.lit(0).cast(R.DECIMAL)).otherwise(C("value")))
    wide = R.wide_rows(t.v_filings, t.v_norm, t.v_concepts, N.zero_issues(kept))
    return R.evaluate(wide, {"SCP-002": R.RULES["SCP-002"]}).select("filing_id", "result")
