"""Mapping versions asked for one after another."""

from pyspark.sql import functions as F

from ..operators import ordered as OR
from .projection import VIEWS
from .registry import query

C = F.col

ASKED = """
    select 'R' || f.o_orderkey as request_id, f.o_orderkey as place, s.series_key, s.source_namespace, s.entry_point, case when f.o_orderkey % 7 = 0 then 'other' else s.source_concept end as source_concept, s.source_concept as own,
        t.top, t.top_id, t.top + f.o_orderkey // 1000 + case when f.o_orderkey % 5 = 0 then 1 else 0 end as expected_version, 'E' || (1 + f.o_orderkey % 2500) as evidence_id
    from v_filings f join v_series s on s.mapping_rule_id = 'M0' || case when f.o_orderkey % 3 = 0 then 1 else 1 + f.o_orderkey % 8 end
    join (select series_key, max(rule_version) as top, arg_max(mapping_rule_id, (rule_version, mapping_rule_id)) as top_id from v_series group by series_key) t on t.series_key = s.series_key
"""
FOLDED = """
    select request_id, series_key, place, top_id, source_concept, case when source_concept <> own then 'MAPPING_SERIES_MISMATCH' end as mismatch, expected_version,
        case when p_partkey is null then 'EVIDENCE_NOT_FOUND' when p_partkey % 10 < 8 and a.source_concept <> case p_partkey % 2 when 0 then 'Quantity' else 'ExtendedPrice' end then 'EVIDENCE_NOT_OWNED' end as evidence_code, top
    from v_asked a left join part on 'E' || p_partkey = a.evidence_id
"""
ACCEPTED = """
    with recursive good as materialized (select * from v_folded where mismatch is null and evidence_code is null),
    chain as (
        select series_key, min(top) as version, cast(-1 as bigint) as place, min(top_id) as id, cast(null as varchar) as before from v_folded group by series_key
        union all
        select series_key, version + 1, place, 'MAP-' || request_id, id from (
            select c.series_key, c.version, c.id, g.place, g.request_id, row_number() over (partition by c.series_key order by g.place, g.request_id) as n
            from chain c join good g on g.series_key = c.series_key and g.expected_version = c.version and g.place > c.place) where n = 1
    )
    select series_key, version, place, id, before from chain
"""
VIEWS |= {"v_asked": (None, ASKED), "v_folded": (None, FOLDED), "v_accepted": (None, ACCEPTED)}


def asked(t):
    """A request for each filing, in the order of their numbers; a third of them for one series."""
    k = C("o_orderkey")
    rule = F.concat(F.lit("M0"), F.when(k % 3 == 0, 1).otherwise(1 + k % 8).cast("string"))
    top = t.v_series.groupBy("series_key").agg(F.max("rule_version").alias("top"))
    r = t.v_filings.select("o_orderkey", rule.alias("mapping_rule_id")).join(t.v_series, "mapping_rule_id").join(top, "series_key")
    expected = C("top") + F.floor(k / 1000) + F.when(k % 5 == 0, 1).otherwise(0)
    return r.select(
        F.concat(F.lit("R"), "o_orderkey").alias("request_id"), k.cast("bigint").alias("place"), "series_key", "source_namespace", "entry_point",
        F.when(k % 7 == 0, "other").otherwise(C("source_concept")).alias("source_concept"), expected.cast("bigint").alias("expected_version"),
        F.array(F.concat(F.lit("E"), 1 + k % 2500)).alias("evidence_ids"),
    )


def evidence(t):
    """A record for each part; two in ten belong to no concept."""
    k = C("p_partkey")
    owner = F.when(k % 10 < 8, F.when(k % 2 == 0, "Quantity").otherwise("ExtendedPrice"))
    return t.part.select(F.concat(F.lit("E"), "p_partkey").alias("evidence_id"), owner.alias("source_concept"))


VIEWS["v_decided"] = (lambda t: OR.versions_in_order(asked(t), t.v_series, evidence(t)), """
    select f.request_id, f.series_key, f.source_concept, coalesce(f.mismatch, case when f.expected_version <> s.version then 'MAPPING_VERSION_STALE' else f.evidence_code end) as code, a.version as rule_version, a.id as mapping_rule_id, a.before as supersedes
    from v_folded f left join v_accepted a on a.id = 'MAP-' || f.request_id
    join (select f2.request_id, max(x.version) as version from v_folded f2 join v_accepted x on x.series_key = f2.series_key and x.place < f2.place group by f2.request_id) s on s.request_id = f.request_id
""")


@query("c36_versions_in_order", "select request_id, code, rule_version, mapping_rule_id, supersedes from v_decided")
def c36(t):
    return t.v_decided.select("request_id", "code", "rule_version", "mapping_rule_id", "supersedes")


@query("c37_version_audit", """
    select 'concept_mapping.version_created' as action, mapping_rule_id as entity_id, '{"mapping_rule_id":"' || supersedes || '","rule_version":' || (rule_version - 1) || '}' as old_value,
        '{"mapping_rule_id":"' || mapping_rule_id || '","rule_version":' || rule_version || ',"source_concept":"' || source_concept || '","supersedes":"' || supersedes || '"}' as new_value
    from v_decided where code is null
""")
def c37(t):
    return OR.version_audit(t.v_decided).drop("actor_id")
