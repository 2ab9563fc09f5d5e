"""Scalar rules over whole tables."""

from pyspark.sql import functions as F

from ..functions import ids, scalars as S
from .registry import query

C = F.col
D = "decimal(36,18)"


@query("p01_lenient_number", """
    select event_id, case when lower(trim(txt)) in ('', 'none', 'null', 'nil', 'nan') then null else cast(try_cast(trim(txt) as decimal(36,18)) as varchar) end as number from v_texts
""")
def p01(t):
    return t.v_texts.select("event_id", S.lenient_number(C("txt")).cast("string").alias("number"))


@query("p02_strict_number", r"select event_id, coalesce(regexp_matches(trim(txt), '^[+-]?(\d+(\.\d+)?|\.\d+)$'), false) as strict from v_texts")
def p02(t):
    return t.v_texts.select("event_id", S.is_strict_number(C("txt")).alias("strict"))


@query("p03_lexical_decimal", r"select event_id, coalesce(regexp_matches(trim(txt), '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'), false) as lexical from v_texts")
def p03(t):
    return t.v_texts.select("event_id", S.is_lexical_decimal(C("txt")).alias("lexical"))


@query("p04_zero_text", r"select event_id, coalesce(regexp_matches(trim(txt), '^[+-]?0(\.0+)?$'), false) as zero from v_texts")
def p04(t):
    return t.v_texts.select("event_id", S.is_zero_text(C("txt")).alias("zero"))


@query("p05_numeric_choice", r"""
    select event_id, case when not is_nil and regexp_matches(trim(txt), '^[+-]?(\d+(\.\d+)?|\.\d+)$') then ltrim(trim(txt), '+') end as value from v_texts
""")
def p05(t):
    return t.v_texts.select("event_id", S.numeric_text(C("is_nil"), F.lit(None).cast("string"), C("txt")).alias("value"))


@query("p06_sign_convention", """
    select n.normalized_fact_id, s.sign, cast(case s.sign when 'AS_REPORTED' then value when 'NEGATE' then case when value = 0 then value else -value end
        when 'ABSOLUTE' then abs(value) when 'NEGATIVE' then case when value = 0 then value else -abs(value) end end as varchar) as signed
    from v_norm n, (values ('AS_REPORTED'), ('NEGATE'), ('ABSOLUTE'), ('NEGATIVE'), ('OTHER')) as s(sign) where value is not null
""")
def p06(t):
    signs = F.array(*map(F.lit, ("AS_REPORTED", "NEGATE", "ABSOLUTE", "NEGATIVE", "OTHER")))
    rows = t.v_norm.where(C("value").isNotNull()).select("normalized_fact_id", "value", F.explode(signs).alias("sign"))
    return rows.select("normalized_fact_id", "sign", S.signed(C("value"), C("sign")).cast("string").alias("signed"))


@query("p07_availability", "select normalized_fact_id, case when is_nil then 'NIL' when value is null then 'MISSING' else 'AVAILABLE' end as availability from v_norm")
def p07(t):
    return t.v_norm.select("normalized_fact_id", S.availability(C("is_nil"), C("value")).alias("availability"))


@query("p08_scope_text", """
    select filing_id, case when lower(scope_text) like '%group%' or lower(scope_text) like '%grup%' then 'CONSOLIDATED'
        when lower(scope_text) like '%single%' or lower(scope_text) like '%tunggal%' or lower(scope_text) like '%individual%' then 'PARENT' else 'UNKNOWN' end as scope from v_filings
""")
def p08(t):
    return t.v_filings.select("filing_id", S.scope_of(C("scope_text")).alias("scope"))


@query("p09_currency_text", """
    select c_custkey, case when txt like '%USD%' or txt like '%DOLLAR%' or txt like '%AMERIKA%' then 'USD' when txt like '%IDR%' or txt like '%RUPIAH%' then 'IDR' end as currency
    from (select c_custkey, upper(case c_custkey % 4 when 0 then 'Rupiah / IDR' when 1 then 'us dollar' when 2 then ' amerika, rupiah' else c_mktsegment end) as txt from customer)
""")
def p09(t):
    k = C("c_custkey") % 4
    text = F.when(k == 0, "Rupiah / IDR").when(k == 1, "us dollar").when(k == 2, " amerika, rupiah").otherwise(C("c_mktsegment"))
    return t.customer.select("c_custkey", S.currency_of(text).alias("currency"))


@query("p10_entry_class", "select filing_id, case when entry_point like '%financesharia%' then 'financesharia' when entry_point like '%infrastructure%' then 'infrastructure' else 'general' end as entry_class from v_filings")
def p10(t):
    return t.v_filings.select("filing_id", S.entry_class(C("entry_point")).alias("entry_class"))


@query("p11_quarter_end", "select filing_id, case right(fiscal_period, 2) when 'Q1' then '-03-31' when 'Q2' then '-06-30' when 'Q3' then '-09-30' when 'Q4' then '-12-31' end as month_day from v_filings")
def p11(t):
    return t.v_filings.select("filing_id", S.quarter_end(C("fiscal_period")).alias("month_day"))


@query("p12_strict_date", r"""
    select o_orderkey, txt, coalesce(regexp_matches(txt, '^\d{4}-\d{2}-\d{2}$') and strftime(try_strptime(txt, '%Y-%m-%d'), '%Y-%m-%d') = txt, false) as valid
    from (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y/%m/%d') when 2 then strftime(o_orderdate, '%Y-%m-31') else strftime(o_orderdate, '%Y-%m') end as txt from orders)
""")
def p12(t):
    k, day = C("o_orderkey") % 4, C("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/MM/dd")).when(k == 2, F.date_format(day, "yyyy-MM-'31'")).otherwise(F.date_format(day, "yyyy-MM"))
    return t.orders.select("o_orderkey", text.alias("txt"), S.is_strict_date(text).alias("valid"))


@query("p13_utc_timestamp", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') as utc from events")
def p13(t):
    return t.events.select("event_id", S.utc_text(C("ts")).alias("utc"))


@query("p14_identifiers", r"""
    select c_custkey, coalesce(strlen(name) <= 128 and regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9._-]*$'), false) as identifier,
        coalesce(strlen(name) <= 20 and regexp_matches(name, '^[A-Za-z0-9._-]+$'), false) as fiscal_period, coalesce(regexp_matches(lower(name), '^[a-z0-9][a-z0-9._-]{0,63}$'), false) as adapter
    from (select c_custkey, case c_custkey % 3 when 0 then c_name when 1 then replace(c_name, '#', '-') else c_mktsegment end as name from customer)
""")
def p14(t):
    k = C("c_custkey") % 3
    name = F.when(k == 0, C("c_name")).when(k == 1, F.replace("c_name", F.lit("#"), F.lit("-"))).otherwise(C("c_mktsegment"))
    return t.customer.select("c_custkey", S.is_identifier(name).alias("identifier"), S.is_fiscal_period(name).alias("fiscal_period"), S.is_adapter(F.lower(name)).alias("adapter"))


URLS = """(select page_id, case page_id % 6 when 0 then replace(url, '://', '://10.0.0.') when 1 then replace(url, 'http', 'ftp') when 2 then regexp_replace(url, '^([^:]+://[^/]+)', '\\1:8080') else url end as url from pages)"""


def _urls(t):
    k, url = C("page_id") % 6, C("url")
    return t.pages.select("page_id", F.when(k == 0, F.replace(url, F.lit("://"), F.lit("://10.0.0."))).when(k == 1, F.replace(url, F.lit("http"), F.lit("ftp"))).when(k == 2, F.regexp_replace(url, "^([^:]+://[^/]+)", "$1:8080")).otherwise(url).alias("url"))


@query("p15_source_url", rf"""
    select page_id, case when scheme not in ('http', 'https') or host = '' then 'invalid' when port not in ('', '80', '443') then 'port'
        when not (host like '%.example.com' or host like '%.example.net') then 'host' when regexp_matches(host, '^(10\.|127\.)[0-9.]+$') then 'private' end as problem
    from (select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]+)', 1)) as host, regexp_extract(url, '^[^:/?#]+://[^/?#]*:(\d+)', 1) as port from {URLS})
""")
def p15(t):
    return _urls(t).select("page_id", S.url_problem(C("url"), ["*.example.com", "*.example.net"]).alias("problem"))


PATHS = "case p_partkey % 5 when 0 then p_name when 1 then '/' || p_name when 2 then p_name || '/../x' when 3 then p_name || chr(7) else '  ' end"


@query("p16_relative_path", rf"""
    select p_partkey, path <> '' and not starts_with(path, '/') and not regexp_matches(path, '(^|/)\.\.(/|$)') and not regexp_matches(path, '[\x00-\x1F\x7F]') as relative from (select p_partkey, trim({PATHS}) as path from part)
""")
def p16(t):
    k, name = C("p_partkey") % 5, C("p_name")
    path = F.when(k == 0, name).when(k == 1, F.concat(F.lit("/"), name)).when(k == 2, F.concat(name, F.lit("/../x"))).when(k == 3, F.concat(name, F.lit("\x07"))).otherwise("  ")
    return t.part.select("p_partkey", S.is_relative_path(path).alias("relative"))


@query("p17_safe_filename", r"""
    select page_id, case when name not in ('', '.', '..') then name end as filename from (select page_id, regexp_replace(regexp_extract(replace(trim(url), '\', '/'), '([^/]*)/*$', 1), '[^A-Za-z0-9._-]', '_', 'g') as name from pages)
""")
def p17(t):
    return t.pages.select("page_id", S.safe_filename(C("url")).alias("filename"))


@query("p18_enums", "select event_id, kind, kind in ('XBRL_INSTANCE', 'INLINE_XBRL', 'XLSX', 'PDF', 'OTHER') as source_type, kind in ('ANNUAL', 'QUARTERLY', 'INTERIM', 'OTHER') as report_type from (select event_id, case event_type when 'click' then 'PDF' when 'view' then 'ANNUAL' when 'error' then 'OTHER' else upper(event_type) end as kind from events)")
def p18(t):
    kind = F.when(C("event_type") == "click", "PDF").when(C("event_type") == "view", "ANNUAL").when(C("event_type") == "error", "OTHER").otherwise(F.upper("event_type"))
    return t.events.select("event_id", kind.alias("kind"), S.one_of(kind, S.SOURCE_TYPES).alias("source_type"), S.one_of(kind, S.REPORT_TYPES).alias("report_type"))


@query("p19_mapping_status", "select event_id, case upper(s) when 'PROPOSED' then 'DRAFT' when 'CONFIRMED' then 'APPROVED' else upper(s) end as status from (select event_id, case event_type when 'click' then 'proposed' when 'view' then 'CONFIRMED' else event_type end as s from events)")
def p19(t):
    s = F.when(C("event_type") == "click", "proposed").when(C("event_type") == "view", "CONFIRMED").otherwise(C("event_type"))
    return t.events.select("event_id", S.mapping_status(s).alias("status"))


@query("p20_trailing_version", r"select c_custkey, case when d = '' then 1 else cast(d as bigint) end as version from (select c_custkey, regexp_extract(case when c_custkey % 3 = 0 then c_mktsegment else c_name end, '(\d+)$', 1) as d from customer)")
def p20(t):
    return t.customer.select("c_custkey", S.trailing_version(F.when(C("c_custkey") % 3 == 0, C("c_mktsegment")).otherwise(C("c_name"))).alias("version"))


@query("p21_listed", "select p_partkey, len(l) as n, array_to_string(l, '|') as items from (select p_partkey, list_filter(list_transform(string_split(p_name || ';; ' || p_brand || ';' || p_type || ' ;', ';'), lambda x: trim(x)), lambda x: x <> '') as l from part)")
def p21(t):
    items = S.listed(F.concat("p_name", F.lit(";; "), "p_brand", F.lit(";"), "p_type", F.lit(" ;")))
    return t.part.select("p_partkey", F.size(items).cast("bigint").alias("n"), F.array_join(items, "|").alias("items"))


@query("p22_series_key", "select distinct source_concept, source_namespace, entry_point, sha256(source_namespace || '|' || source_concept || '|' || entry_point) as series_key, sha256(source_concept || '|' || entry_point) as plain_key from v_norm")
def p22(t):
    rows = t.v_norm.select("source_concept", "source_namespace", "entry_point").distinct()
    return rows.select("*", ids.series_key(C("source_namespace"), C("source_concept"), C("entry_point")).alias("series_key"), ids.series_key(F.lit(""), C("source_concept"), C("entry_point")).alias("plain_key"))


@query("p23_extraction_ids", r"""
    select raw_fact_id, 'ctx_' || substr(sha256(filing_id || chr(31) || context_id), 1, 24) as ctx_key, 'unit_' || substr(sha256(filing_id || chr(31) || coalesce(unit_currency, '')), 1, 24) as unit_key,
        'dim_' || substr(sha256(concat_ws(chr(31), filing_id, context_id, 'axis', '', '')), 1, 24) as dim_key, 'fact_' || substr(sha256(source_concept || chr(31) || '0'), 1, 24) as fact_key from v_raw_facts
""")
def p23(t):
    null = F.lit(None).cast("string")
    return t.v_raw_facts.select(
        "raw_fact_id", ids.extraction_id("ctx_", "filing_id", "context_id").alias("ctx_key"), ids.extraction_id("unit_", "filing_id", "unit_currency").alias("unit_key"),
        ids.extraction_id("dim_", "filing_id", "context_id", F.lit("axis"), null, null).alias("dim_key"), ids.extraction_id("fact_", "source_concept", F.lit(0)).alias("fact_key"),
    )


@query("p24_stored_id", "select context_id, 'ctx_' || substr(sha256(concat_ws('|', c.filing_id, source_hash, '1.0', 'cfg', context_id)), 1, 24) as stored from v_contexts c join v_filings f on c.filing_id = f.filing_id")
def p24(t):
    rows = t.v_contexts.join(t.v_filings.select("filing_id", "source_hash"), "filing_id")
    return rows.select("context_id", ids.stored_id("ctx_", "filing_id", "source_hash", F.lit("1.0"), F.lit("cfg"), "context_id").alias("stored"))


@query("p25_normalized_id", """
    select normalized_fact_id, 'nf_' || substr(sha256(concat_ws('|', filing_id, raw_fact_id, mapping_rule_id, '1', 'v1', 'NONE')), 1, 48) as nf_key,
        'normalization_issue_' || substr(sha256(concat_ws('|', filing_id, raw_fact_id, 'v1', 'UNMAPPED', '')), 1, 40) as issue_key from v_norm
""")
def p25(t):
    return t.v_norm.select(
        "normalized_fact_id", ids.normalized_fact_id("filing_id", "raw_fact_id", "mapping_rule_id", "mapping_rule_version", F.lit("v1"), F.lit("NONE")).alias("nf_key"),
        ids.issue_id("filing_id", "raw_fact_id", F.lit("v1"), F.lit("UNMAPPED"), F.lit(None)).alias("issue_key"),
    )


@query("p26_result_ids", """
    select filing_id, 'vr_' || substr(sha256(concat_ws('|', filing_id, 'd', 'r', 'ACC-001', '1')), 1, 48) as result_key, 'PUB-' || substr(sha256(concat_ws('|', filing_id, revision_number, '7', '1.0')), 1, 60) as snapshot_key,
        'ART-' || sha256(concat_ws('|', filing_id, 'PDF', source_hash)) as artifact_key from v_filings
""")
def p26(t):
    return t.v_filings.select(
        "filing_id", ids.result_id("filing_id", F.lit("d"), F.lit("r"), F.lit("ACC-001"), F.lit(1)).alias("result_key"),
        ids.snapshot_id("filing_id", "revision_number", F.lit(7), F.lit("1.0")).alias("snapshot_key"), ids.artifact_id("filing_id", F.lit("PDF"), "source_hash").alias("artifact_key"),
    )


@query("p27_idempotency_key", """
    select page_id, case when loc <> '' then sha256('download|filing_id=F' || page_id || '|source_locator=' || replace(replace(replace(loc, '%', '%25'), '|', '%7C'), '=', '%3D') || '|revision_identifier=1') end as idempotency_key
    from (select page_id, case when page_id % 10 = 0 then '' else url end as loc from pages)
""")
def p27(t):
    inputs = {"filing_id": F.concat(F.lit("F"), "page_id"), "source_locator": F.when(C("page_id") % 10 == 0, "").otherwise(C("url")), "revision_identifier": F.lit(1)}
    return t.pages.select("page_id", ids.idempotency_key("download", inputs).alias("idempotency_key"))


@query("p28_source_element_id", "select raw_fact_id, case when line % 2 = 0 then context_id else 'derived-' || substr(sha256(source_concept || raw_value), 1, 32) end as element_id from v_raw_facts")
def p28(t):
    given = [F.when(C("line") % 2 == 0, C("context_id")).otherwise("")]
    return t.v_raw_facts.select("raw_fact_id", ids.source_element_id(given, F.concat("source_concept", "raw_value")).alias("element_id"))


@query("p29_review_version", "select normalized_fact_id, concat_ws('|', 'v1', mapping_rule_id, mapping_rule_version) as review_version from v_norm")
def p29(t):
    return t.v_norm.select("normalized_fact_id", ids.review_version(F.lit("v1"), C("mapping_rule_id"), C("mapping_rule_version")).alias("review_version"))


@query("p30_json_path", "select event_id, json_extract_string(props, '$.k') as k from events")
def p30(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("p31_text_search", "select p_partkey from part where contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def p31(t):
    return t.part.where(S.contains_text("Brand#1", C("p_name"), C("p_brand"), C("p_type"))).select("p_partkey")


@query("p32_period_filter", "select filing_id, '1997' as term from v_filings where fiscal_year = 1997 union all select filing_id, 'Q2' from v_filings where fiscal_period = 'Q2'")
def p32(t):
    return t.v_filings.where(S.period_filter("1997")).select("filing_id", F.lit("1997").alias("term")).unionAll(t.v_filings.where(S.period_filter("Q2")).select("filing_id", F.lit("Q2").alias("term")))


@query("p33_redaction", r"""
    select event_id, regexp_replace('call failed: Token=' || event_id || ', Bearer abc' || user_id || '; api-key : x y', '(?i)(Bearer\s+|(?:token|secret|password|api[_-]?key)\s*[=:]\s*)[^\s,;]+', '\1[REDACTED]', 'g') as message, '[REDACTED]' as secret_value, event_type as plain_value from events
""")
def p33(t):
    text = F.concat(F.lit("call failed: Token="), "event_id", F.lit(", Bearer abc"), "user_id", F.lit("; api-key : x y"))
    kept = S.redact_map(F.create_map(F.lit("Api-Key"), C("event_id").cast("string"), F.lit("kind"), C("event_type")))
    return t.events.select("event_id", S.redact(text).alias("message"), kept["Api-Key"].alias("secret_value"), kept["kind"].alias("plain_value"))


@query("p34_fact_period", "select context_id, cast(case when period_type = 'DURATION' then start_date end as varchar) as period_start, cast(case when period_type = 'DURATION' then end_date else instant_date end as varchar) as period_end from v_contexts")
def p34(t):
    start, end = S.fact_period(C("period_type"), C("start_date"), C("end_date"), C("instant_date"))
    return t.v_contexts.select("context_id", start.cast("string").alias("period_start"), end.cast("string").alias("period_end"))


@query("p35_published_number", r"select event_id, coalesce(regexp_matches(txt, '^-?(0|[1-9]\d*)(\.\d+)?$'), false) as published from v_texts")
def p35(t):
    return t.v_texts.select("event_id", S.is_published_number(C("txt")).alias("published"))


@query("p36_logical_reference", r"select p_partkey, not regexp_matches(ref, '^([A-Za-z]:[\\/]|[\\/]|https?://)') as logical from (select p_partkey, case p_partkey % 4 when 0 then 'C:\' || p_name when 1 then '/' || p_name when 2 then 'https://' || p_name else p_name end as ref from part)")
def p36(t):
    k, n = C("p_partkey") % 4, C("p_name")
    ref = F.when(k == 0, F.concat(F.lit("C:\\"), n)).when(k == 1, F.concat(F.lit("/"), n)).when(k == 2, F.concat(F.lit("https://"), n)).otherwise(n)
    return t.part.select("p_partkey", S.is_logical_reference(ref).alias("logical"))


@query("p37_tolerance", "select a.filing_id, abs(a.value - b.value) <= 1000 as within from v_norm a join v_norm b on a.filing_id = b.filing_id where a.canonical_concept = 'total_assets' and b.canonical_concept = 'revenue'")
def p37(t):
    a = t.v_norm.where(C("canonical_concept") == "total_assets").select("filing_id", C("value").alias("a"))
    b = t.v_norm.where(C("canonical_concept") == "revenue").select("filing_id", C("value").alias("b"))
    return a.join(b, "filing_id").select("filing_id", S.within_tolerance(C("a"), C("b")).alias("within"))


@query("p38_action_flags", """
    select filing_id, storage_path is not null as view_artifact, case when storage_path is null then 'ARTIFACT_UNAVAILABLE' end as view_artifact_reason,
        quality_status = 'VERIFIED' as publish, case when quality_status <> 'VERIFIED' then 'NOT_VERIFIED' end as publish_reason from v_filings
""")
def p38(t):
    def flag(allowed, reason):
        return F.struct(allowed.alias("allowed"), F.when(~allowed, reason).alias("reason"))

    flags = t.v_filings.select("filing_id", flag(C("storage_path").isNotNull(), "ARTIFACT_UNAVAILABLE").alias("v"), flag(C("quality_status") == "VERIFIED", "NOT_VERIFIED").alias("p"))
    return flags.select("filing_id", C("v.allowed").alias("view_artifact"), C("v.reason").alias("view_artifact_reason"), C("p.allowed").alias("publish"), C("p.reason").alias("publish_reason"))
