"""Reference data as large as the tables, held against its rules."""

from pyspark.sql import functions as F

from ..operators import contracts as CT, reference_data as RD
from .projection import ENTRY, VIEWS
from .registry import query

C = F.col

_K = "p_partkey % 60"
DICTIONARY = f"""
    select 'concept_' || p_partkey as canonical_concept, ['balance_sheet', 'income_statement', 'notes'][1 + p_partkey % 3] as statement, case {_K} when 1 then 'monthly' else ['instant', 'duration'][1 + p_partkey % 2] end as period_type,
        case {_K} when 2 then 'negated' else 'source sign' end as sign_convention, case {_K} when 3 then 'group' else 'group; single' end as allowed_scope, case {_K} when 4 then 'always' else 'required' end as required from part
"""
MAPPED = f"""
    select 'src_' || (c_custkey - case when c_custkey % 40 = 5 then 1 else 0 end) as source_concept, 'n' as concept_namespace, '{ENTRY}general' || case when c_custkey % 30 = 7 then ';{ENTRY}other' else '' end as entry_point,
        'concept_' || c_custkey * 2 as canonical_concept, case when c_custkey % 25 = 9 then 'DRAFT' else 'CONFIRMED' end as status from customer
"""


def dictionary(t):
    """A concept for each part; some have a value that a dictionary may not have, and no cash flow statement is among them."""
    k, of = C("p_partkey") % 60, lambda *names: F.element_at(F.array(*map(F.lit, names)), (C("p_partkey") % len(names) + 1).cast("int"))
    return t.part.select(
        F.concat(F.lit("concept_"), "p_partkey").alias("canonical_concept"), of("balance_sheet", "income_statement", "notes").alias("statement"), F.when(k == 1, "monthly").otherwise(of("instant", "duration")).alias("period_type"),
        F.when(k == 2, "negated").otherwise("source sign").alias("sign_convention"), F.when(k == 3, "group").otherwise("group; single").alias("allowed_scope"), F.when(k == 4, "always").otherwise("required").alias("required"),
    )


def mapped(t):
    """A mapping for each customer, whose orders are the facts of its source; some repeat another's source or name what is unknown."""
    k = C("c_custkey")
    return t.customer.select(
        F.concat(F.lit("src_"), k - F.when(k % 40 == 5, 1).otherwise(0)).alias("source_concept"), F.lit("n").alias("concept_namespace"), F.concat(F.lit(ENTRY + "general"), F.when(k % 30 == 7, f";{ENTRY}other").otherwise("")).alias("entry_point"),
        F.concat(F.lit("concept_"), k * 2).alias("canonical_concept"), F.when(k % 25 == 9, "DRAFT").otherwise("CONFIRMED").alias("status"),
    )


VIEWS |= {"v_dictionary_rows": (dictionary, DICTIONARY), "v_mapping_rows": (mapped, MAPPED)}

VIOLATIONS = f"""
    select 'PERIOD_TYPE_UNKNOWN' as "check", canonical_concept as id from v_dictionary_rows where period_type not in ('instant', 'duration')
    union all select 'SIGN_CONVENTION_UNKNOWN', canonical_concept from v_dictionary_rows where sign_convention <> 'source sign'
    union all select 'SCOPES_UNLIKE_BOTH', canonical_concept from v_dictionary_rows where allowed_scope <> 'group; single'
    union all select 'REQUIREDNESS_UNKNOWN', canonical_concept from v_dictionary_rows where required not in ('required', 'optional')
    union all select 'STATEMENT_MISSING', s from (values ('balance_sheet'), ('cash_flow'), ('income_statement')) as x(s) where s not in (select statement from v_dictionary_rows)
    union all select 'DICTIONARY_TOO_SMALL', cast(count(*) as varchar) from v_dictionary_rows having count(*) < 30
    union all select 'MAPPING_CONCEPT_UNKNOWN', 'n#' || source_concept from v_mapping_rows where canonical_concept not in (select canonical_concept from v_dictionary_rows)
    union all select 'MAPPING_SOURCE_ABSENT', 'n#' || source_concept from v_mapping_rows where source_concept not in (select 'src_' || o_custkey from orders)
    union all select 'MAPPING_STATUS_UNKNOWN', 'n#' || source_concept from v_mapping_rows where status = 'DRAFT'
    union all select 'MAPPING_REPEATED', 'n#' || source_concept from v_mapping_rows where source_concept in (select source_concept from v_mapping_rows group by 1 having count(*) > 1)
    union all select distinct 'MAPPING_ENTRY_POINT_UNKNOWN', 'n#' || source_concept from v_mapping_rows where entry_point like '%;%'
"""


def violations(t):
    facts = t.orders.select(F.concat(F.lit("src_"), "o_custkey").alias("source_concept"), F.lit("n").alias("concept_namespace"))
    points = t.v_filings.select("entry_point").distinct()
    return RD.dictionary_violations(t.v_dictionary_rows).unionAll(RD.mapping_violations(t.v_mapping_rows, t.v_dictionary_rows, facts, points))


VIEWS["v_reference_violations"] = (violations, VIOLATIONS)


@query("j31_reference_violations", 'select "check", id from v_reference_violations')
def j31(t):
    return t.v_reference_violations


_TESTS = """
    select 'TESTS_FAILED' as "check", count(*) as n from (select x.filing_id from v_norm x left join v_norm n on n.filing_id = x.filing_id and n.canonical_concept = 'revenue' and not n.dimensioned
        where x.canonical_concept = 'revenue' and right(x.normalized_fact_id, 2) = '10' group by x.filing_id having count(n.normalized_fact_id) <> 1)
"""


@query("c44_reference_report", f"""
    select "check", count(*) as n from v_reference_violations group by 1 union all select 'DICTIONARY_ROWS', count(*) from v_dictionary_rows union all select 'MAPPING_ROWS', count(*) from v_mapping_rows
    union all select 'TESTS', count(*) from v_norm where canonical_concept = 'revenue' and right(normalized_fact_id, 2) = '10' union all {_TESTS}
""")
def c44(t):
    """One report of dictionary, mappings and a test of each filing's revenue."""
    own = t.v_norm.where((C("canonical_concept") == "revenue") & C("normalized_fact_id").endswith("10"))
    pack = own.select(C("filing_id").alias("test_id"), "filing_id", "canonical_concept", C("unit_ref").alias("expected_unit"), C("is_nil").alias("expected_nil"), C("value").alias("expected_value"))
    failed = CT.test_pack(pack, t.v_norm).where(~C("passes")).select(F.lit("TESTS_FAILED").alias("check"), C("test_id").alias("id"))
    sizes = {"DICTIONARY_ROWS": t.v_dictionary_rows, "MAPPING_ROWS": t.v_mapping_rows, "TESTS": pack}
    return RD.report(t.v_reference_violations.unionAll(failed), sizes)


@query("s25_import_plan", """
    select r.source_concept, case when len(checks) > 0 then 'REFUSED' when k % 3 = 0 then 'UNCHANGED' when k % 3 = 1 then 'NEW_VERSION' else 'NEW' end as decision, array_to_string(coalesce(checks, []), ',') as checks
    from (select *, cast(substr(source_concept, 5) as bigint) as k from v_mapping_rows) r
    left join (select id, list_sort(list_distinct(list("check"))) as checks from v_reference_violations group by id) v on v.id = 'n#' || r.source_concept
""")
def s25(t):
    """A dry run of an import of all mappings, two thirds of which are stored, half of these with another status."""
    k = F.substring("source_concept", 5, 20).cast("bigint")
    stored = t.v_mapping_rows.where(k % 3 < 2).withColumn("status", F.when(k % 3 == 1, "OLD").otherwise(C("status"))).dropDuplicates(["source_concept", "concept_namespace"])
    plan = RD.import_plan(t.v_mapping_rows, stored, ["source_concept", "concept_namespace"], ["entry_point", "canonical_concept", "status"], t.v_reference_violations, F.concat_ws("#", "concept_namespace", "source_concept"))
    return plan.select("source_concept", "decision", F.array_join("checks", ",").alias("checks"))
