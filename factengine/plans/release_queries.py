"""Executions as versions, counters of a release, archives as a source (J23, A21, S06f)."""

from pyspark.sql import functions as F

from ..operators import counters as CO, executions as EX, publish as P
from ..sources import xbrl as X
from ..sources.sinks import scratch, shuffles_let_go
from .ops_queries import snapshot_rows, xbrl_documents
from .projection import VIEWS
from .registry import query
from .whole_queries import tampered_snapshots

C = F.col
AS_OF = "1996-06-30"

EXECUTIONS = """
    select o_orderkey * 4 + n as execution_id, filing_id, case when (o_orderkey + n) % 11 > 0 then 'd' || n end as dataset_version, 'r' || n % 2 as rule_set_version, published_at + to_days(cast(n * 30 as int)) as finished_at, (o_orderkey + n) % 5 > 0 as complete
    from v_filings, range(3) as x(n) where n <= o_orderkey % 3
"""


def executions(t):
    """One to three executions of a filing, a month apart; some not complete, some without a data set."""
    n = F.explode(F.sequence(F.lit(0), (C("o_orderkey") % 3).cast("int"))).alias("n")
    rows = t.v_filings.select("filing_id", "o_orderkey", "published_at", n)
    return rows.select(
        (C("o_orderkey") * 4 + C("n")).alias("execution_id"), "filing_id", F.when((C("o_orderkey") + C("n")) % 11 > 0, F.concat(F.lit("d"), "n")).alias("dataset_version"),
        F.concat(F.lit("r"), (C("n") % 2).cast("string")).alias("rule_set_version"), (C("published_at") + F.make_dt_interval(C("n") * 30)).alias("finished_at"), ((C("o_orderkey") + C("n")) % 5 > 0).alias("complete"),
    )


#: Facts of a data set: those whose place modulo 3 is another number; results: the first data sets' facts, judged positive or not.
VERSIONED = """
    select e.filing_id, e.dataset_version, e.rule_set_version, e.execution_id, n.normalized_fact_id, n.value > 0 as positive
    from v_executions e join v_norm n on n.filing_id = e.filing_id where cast(right(n.normalized_fact_id, 2) as int) % 3 <> cast(right(e.dataset_version, 1) as int)
"""


def versioned(t):
    place = F.substring("normalized_fact_id", -2, 2).cast("int") % 3
    both = t.v_executions.join(t.v_norm.select("filing_id", "normalized_fact_id", "value"), "filing_id")
    return both.where(place != F.substring("dataset_version", -1, 1).cast("int")).select("filing_id", "dataset_version", "rule_set_version", "execution_id", "normalized_fact_id", (C("value") > 0).alias("positive"))


_LATEST = """
    select filing_id, execution_id, dataset_version, rule_set_version from v_executions where complete and dataset_version is not null{} qualify row_number() over (partition by filing_id order by finished_at desc, execution_id desc) = 1
"""
VIEWS |= {"v_executions": (executions, EXECUTIONS), "v_versioned": (versioned, VERSIONED)}
_ROWS = """
    select l.filing_id, l.execution_id, l.dataset_version, l.rule_set_version, count(*) as facts, cast(sum(case when positive then 1 else 0 end) as bigint) as positive
    from ({}) l join v_versioned v on v.filing_id = l.filing_id and v.dataset_version = l.dataset_version and v.rule_set_version = l.rule_set_version group by all
"""


def selected(t, as_of=None):
    latest = EX.latest_execution(t.v_executions, as_of)
    results = t.v_versioned.select("filing_id", "dataset_version", "rule_set_version", "positive")
    kept, facts = EX.of_execution(latest, results, t.v_versioned.select("filing_id", "dataset_version", "normalized_fact_id"))
    n = facts.groupBy("filing_id").agg(F.count("*").alias("facts"))
    yes = kept.groupBy("filing_id").agg(F.sum(F.when(C("positive"), 1).otherwise(0)).cast("bigint").alias("positive"))
    return latest.join(n, "filing_id").join(yes, "filing_id")


@query("j29_latest_execution_rows", _ROWS.format(_LATEST.format("")))
def j29(t):
    """Facts and results of each filing's latest complete execution and of no other."""
    return selected(t)


@query("j30_execution_as_of", _ROWS.format(_LATEST.format(f" and finished_at <= timestamp '{AS_OF}'")))
def j30(t):
    return selected(t, F.lit(AS_OF).cast("timestamp_ntz"))


@query("a26_mixed_versions", """
    select v.filing_id, v.dataset_version, v.rule_set_version, count(*) as results from v_versioned v
    where not exists (select 1 from v_executions e where e.complete and e.filing_id = v.filing_id and e.dataset_version = v.dataset_version and e.rule_set_version = v.rule_set_version) group by all
""")
def a26(t):
    return EX.mixed_versions(t.v_executions, t.v_versioned)


def _sets(name: str, rows: str, keys: dict[str, str], versions: dict[str, str]) -> str:
    parts = []
    for key, value in keys.items():
        for version in (None, *versions):
            of = "cast(null as varchar)" if version is None else f"'{version}=' || coalesce(cast({versions[version]} as varchar), '')"
            parts.append(f"select '{key}' as counter, {of} as version, coalesce(cast({value} as varchar), '') as key, count(*) as n from ({rows}) {name} group by all")
    return " union all ".join(parts)


_OUTCOMES = """select o.*, case when is_nil then 'NIL' when reason is not null then 'UNKNOWN' when txt is null then 'MISSING' else 'AVAILABLE' end as availability, case when reason is null then m.ver end as mapping_version, 'v1' as normalization_version from v_outcomes o"""
_VERDICTS = "select r.rule_code, r.result, s.status, r.rule_version from v_results r join v_status s on s.filing_id = r.filing_id"
_DOCUMENT_CODE = """
    select case when o_orderkey % 10 = 1 then 'MISSING_SNAPSHOT_ID' when quality_status <> 'VERIFIED' then 'NON_VERIFIED_SNAPSHOT' when o_orderkey % 10 = 2 then 'MISSING_SOURCE_PROVENANCE' when o_orderkey % 10 = 3 then 'UNSAFE_STORAGE_REFERENCE'
        when o_orderkey % 10 = 4 and missing then 'INVALID_DECIMAL_STRING' when o_orderkey % 10 = 7 then 'MISSING_FACT_LINEAGE' when o_orderkey % 10 = 8 then 'INVALID_LIMITATION' when o_orderkey % 10 = 9 then 'MALFORMED_SNAPSHOT' else 'PUBLISHED' end as rejection,
        case when o_orderkey % 10 = 9 then '0' else '1.0' end as contract_version
    from v_filings f join (select filing_id, bool_or(value is null) as missing from v_norm group by filing_id) n on n.filing_id = f.filing_id
"""


@query("a25_counters_by_version", " union all ".join((
    _sets("o", _OUTCOMES, {"normalization": "status", "availability": "availability", "reason": "reason"}, {"normalization_version": "normalization_version", "mapping_version": "mapping_version"}),
    _sets("r", _VERDICTS, {"executed": "rule_code", "result": "result"}, {"rule_version": "rule_version"}),
    _sets("d", _DOCUMENT_CODE, {"rejection": "rejection"}, {"contract_version": "contract_version"}),
)))
def a25(t):
    """Normalization, availability, executed rules and publish rejections, in all and by version; every table is scanned once."""
    outcomes = t.v_outcomes.select(C("status").alias("normalization"), "availability", "reason", "normalization_version", C("mapping_rule_version").alias("mapping_version"))
    null = F.lit(None).cast("string")
    columns = ("executed", "result", "rule_version", "rejection", "contract_version")
    one = lambda *values: F.struct(*[v.alias(c) for c, v in zip(columns, values)])
    code = F.when(C("facts").isNotNull(), F.coalesce(P.document_code(), F.lit("PUBLISHED")))  # filings without facts have no document
    rows = tampered_snapshots(t, snapshot_rows(t, reported=False, keep=["outcomes", "once"])).select("outcomes", "once", "contract_version", code.alias("code"))
    results = F.when(C("once"), F.transform("outcomes", lambda x: one(x["rule_code"], x["o"]["result"], x["rule_version"], null, null)))
    codes = F.when(C("code").isNotNull(), F.array(one(null, null, F.lit(None).cast("bigint"), C("code"), C("contract_version"))))
    said = F.explode(F.array(results, codes)).alias("said")
    judged = rows.select(said).select(F.explode("said").alias("x")).select("x.*")
    every = CO.counted_sets(judged, [(C("executed").isNotNull(), ["rule_version"], ["executed", "result"]), (C("rejection").isNotNull(), ["contract_version"], ["rejection"])])
    of_facts = CO.counted_sets(outcomes, [(F.lit(True), ["normalization_version", "mapping_version"], ["normalization", "availability", "reason"])])
    return of_facts.unionByName(every)


def archives(t):
    """A zip of each filing's instance with its taxonomy; by the filing's number one is broken, one empty, one too large."""
    k = F.substring("filing_id", 2, 20).cast("bigint") % 23
    point = F.element_at(F.array(*map(F.lit, ("http://x/entry/general", "http://x/entry/financesharia", "http://x/entry/infrastructure"))), (k % 3 + 1).cast("int"))
    rows = xbrl_documents(t).select("filing_id", "document", point.alias("namespace"), k.cast("int").alias("kind"))
    return X.zipped(rows)


@query("s24_archives", """
    select 'I-' || r.filing_id as filing_id, case k when 5 then 'BAD_ARCHIVE' when 7 then 'NO_INSTANCE' when 11 then 'TOO_LARGE' end as problem,
        case when k in (5, 11) then null else ['general', 'financesharia', 'infrastructure'][1 + k % 3] end as entry_point, case when k in (5, 7, 11) then 0 else facts end as facts
    from (select filing_id, cast(substr(filing_id, 2) as bigint) % 23 as k, count(*) as facts from v_raw_facts group by all) r
""")
def s24(t):
    """Archives stored as files of bytes, opened within a bound, with their instances' facts."""
    path = scratch(t.spark, "archives")
    with shuffles_let_go(t.spark):
        archives(t).write.parquet(path)
    opened = X.open_archives(t.spark.read.parquet(path), most_bytes=1 << 16)
    home = scratch(t.spark, "opened")
    opened.write.parquet(home)
    opened = t.spark.read.parquet(home)
    records = scratch(t.spark, "records")  # parsed once, read for the contexts and for the facts
    X.extract(opened.where(C("document").isNotNull())).write.parquet(records)
    facts = X.facts(t.spark.read.schema(X.ROW).parquet(records)).groupBy("filing_id").agg(F.count("*").alias("facts"))
    return opened.join(facts, "filing_id", "left").select("filing_id", "problem", "entry_point", F.coalesce("facts", F.lit(0)).cast("bigint").alias("facts"))


@query("s26_schema_metadata", """
    select filing_id, case when o_orderkey % 19 = 4 then null else 'http://t/' || fiscal_period end as target_namespace, case when o_orderkey % 19 = 4 then '' else 'http://i/' || issuer_code || ',http://i/common' end as imports,
        case when o_orderkey % 19 = 4 then '' else 'a.xsd' end as import_locations, case when o_orderkey % 19 = 4 then '' else 'cal.xml,def.xml' end as linkbase_references,
        case when o_orderkey % 19 = 4 then '' else 'http://r/' || fiscal_year || ',http://r/cal' end as linkbase_roles, o_orderkey % 19 = 4 as broken from v_filings
""")
def s26(t):
    """A schema for each filing, some of them cut off, and what it names."""
    text = F.format_string(
        '<x:schema xmlns:x="http://www.w3.org/2001/XMLSchema" xmlns:l="http://l" xmlns:k="http://k" targetNamespace="http://t/%s"><x:import namespace="http://i/common"/><x:import namespace="http://i/%s" schemaLocation="a.xsd"/><x:import namespace="http://i/common" schemaLocation=" a.xsd"/>'
        '<x:annotation><x:appinfo><l:linkbaseRef k:href="def.xml" k:role="http://r/cal"/><l:linkbaseRef k:href="cal.xml" k:role="http://r/cal"/><l:roleRef roleURI="http://r/%d"/></x:appinfo></x:annotation></x:schema>',
        "fiscal_period", "issuer_code", "fiscal_year",
    )
    cut = F.when(C("o_orderkey") % 19 == 4, F.substring(text, 1, 200)).otherwise(text)
    found = X.schema_metadata(t.v_filings.select("filing_id", cut.alias("schema")))
    lists = [F.array_join(c, ",").alias(c) for c in ("imports", "import_locations", "linkbase_references", "linkbase_roles")]
    return found.select("filing_id", "target_namespace", *lists, C("error").isNotNull().alias("broken"))
