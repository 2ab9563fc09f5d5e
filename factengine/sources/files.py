"""Reference CSV, candidate JSON, parser results and artifacts, under fixed schemas."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import scalars as S

DICTIONARY = ["canonical_concept", "statement", "definition", "period_type", "sign_convention", "allowed_scope", "required", "formula_dependency"]
MAPPING = ["source_concept", "concept_namespace", "entry_point", "canonical_concept", "status", "rationale", "reviewer"]
TEST_PACK = ["test_id", "entry_point", "ticker", "period", "source_concept", "canonical_concept", "current_context", "expected_unit", "expected_is_nil", "expected_value_raw"]
CASES = ["test_case_id", "rule_code", "category", "case_type", "target_entry_point", "description", "input_mock_json", "expected_severity", "expected_status", "expected_message"]
CORRUPT = "_corrupt"
CANDIDATE = (
    "filing_id string, issuer_code string, report_type string, fiscal_year int, fiscal_period string, period_start string, period_end string, source_url string, source_type string, "
    "storage_path string, source_hash string, revision_number int, supersedes_filing_id string, discovered_at string, external_filing_id string, revision_chain_id string, "
    "publication_timestamp string, official_source_available boolean, official_pdf_url string, official_xlsx_url string, official_ixbrl_url string"
)
CANDIDATE_FIELDS = [f.split()[0] for f in CANDIDATE.split(", ")]
REQUIRED = ["filing_id", "issuer_code", "period_end", "source_url", "source_type", "source_hash", "revision_number"]
_CTX = "context_id:string,filing_id:string,source_context_id:string,entity_identifier:string,scope:string,period_type:string,instant_date:string,start_date:string,end_date:string,context_status:string"
_UNIT = "unit_id:string,filing_id:string,source_unit_id:string,unit_type:string,measure:string,currency:string"
_DIM = "dimension_id:string,context_id:string,axis:string,member:string,typed_value:string"
_FACT = "raw_fact_id:string,source_element_id:string,filing_id:string,source_concept:string,source_namespace:string,raw_value:string,normalized_numeric_value:string,context_ref:string,unit_ref:string,decimals:string,precision:string,is_nil:boolean,fact_status:string"
PARSER_RESULT = (
    "parser_contract string, parser_contract_version string, status string, filing_id string, source struct<path:string,sha256:string>, runtime struct<worker_version:string,arelle_version:string,python_version:string>, "
    "taxonomy struct<target_namespace:string,imports:array<string>,import_locations:array<string>,linkbase_roles:array<string>,linkbase_references:array<string>,statement_families:array<string>>, "
    f"counts struct<contexts:int,units:int,dimensions:int,facts:int>, contexts array<struct<{_CTX}>>, units array<struct<{_UNIT}>>, dimensions array<struct<{_DIM}>>, facts array<struct<{_FACT}>>, "
    "warnings array<struct<code:string,message:string,count:int,suppressed_count:int>>, errors array<struct<code:string,message:string>>"
)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV whose header is exactly ``columns``; a ragged row fails the read, blank rows are skipped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("escape", '"').option("multiLine", True).csv(path)
    return rows.where(F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns]).isNotNull())


def read_csv_report(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, ragged rows as text), line by line."""
    ddl = ", ".join(f"{c} string" for c in [*columns, CORRUPT])
    lines = spark.read.text(path).where((F.col("value") != ",".join(columns)) & (F.trim("value") != ""))
    rows = lines.select(F.from_csv("value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'}).alias("r")).select("r.*")
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_cases(spark: SparkSession, path: str, json_schema: str) -> DataFrame:
    """Rule cases with their JSON column parsed into ``input``."""
    return read_csv(spark, path, CASES).withColumn("input", F.from_json("input_mock_json", json_schema))


def import_dictionary(rows: DataFrame) -> DataFrame:
    """Dictionary rows with upper-case, trimmed codes and scopes in the resolver's words."""
    scopes = F.transform(S.listed(F.lower("allowed_scope")), lambda s: F.when(s == "group", "CONSOLIDATED").when(s == "single", "PARENT").otherwise(F.upper(s)))
    return rows.select(F.trim("canonical_concept").alias("code"), "statement", F.upper(F.trim("period_type")).alias("period_type"), F.array_join(scopes, ";").alias("allowed_scope"), F.trim("required").alias("required"), F.when(F.trim("formula_dependency") != "", F.trim("formula_dependency")).alias("formula_dependency"))


def import_mappings(rows: DataFrame, version: str) -> DataFrame:
    """Mapping rows, one per entry point of their list, with translated status and the version's number."""
    points = F.explode_outer(S.listed(F.col("entry_point")))
    out = rows.select("source_concept", F.col("concept_namespace").alias("source_namespace"), points.alias("entry_point"), "canonical_concept", S.mapping_status(F.col("status")).alias("status"), "rationale", "reviewer")
    return out.withColumn("rule_version", S.trailing_version(F.lit(version)))


def refused_imports(manifest: DataFrame, artifact_type: str, version: str, digest: str) -> DataFrame:
    """Manifest rows that forbid this import: the same version with another hash."""
    return manifest.where((F.col("artifact_type") == artifact_type) & (F.col("artifact_version") == version) & (F.col("source_sha256") != digest))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate JSON objects as text, from a bare list or an envelope {"candidates": [...]}."""
    texts = spark.read.option("wholetext", True).text(path)
    list_ = F.from_json("value", "array<variant>")
    inner = F.from_json("value", "candidates array<variant>")["candidates"]
    bare = F.ltrim("value").startswith("[")
    return texts.select(F.explode(F.when(bare, list_).otherwise(inner)).alias("c")).select(F.to_json("c").alias("candidate"))


def candidate_problem(c: Column, raw: Column, hosts: list[str]) -> Column:
    """First reason to reject a candidate (a struct of CANDIDATE, with its JSON text); null for a good one."""
    f = lambda n: F.trim(c[n]) if n not in ("revision_number", "fiscal_year") else c[n]
    missing = F.lit(False)
    for n in REQUIRED:
        missing = missing | c[n].isNull()
    unknown = F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, CANDIDATE_FIELDS)))
    given = lambda n, ok: f(n).isNotNull() & ~ok
    return (
        F.when(c.isNull() | raw.isNull(), "not an object").when(F.size(unknown) > 0, "unknown field").when(missing, "missing field")
        .when(~S.is_identifier(f("filing_id")), "filing identifier").when(~S.is_identifier(F.upper(f("issuer_code")), 32), "issuer code").when(~S.is_strict_date(f("period_end")), "period end")
        .when(given("period_start", S.is_strict_date(f("period_start"))) | (f("period_start") > f("period_end")), "period start").when(S.url_problem(f("source_url"), hosts).isNotNull(), "source url")
        .when(~S.one_of(F.upper(f("source_type")), S.SOURCE_TYPES), "source type").when((f("source_hash") == "") | (F.length(f("source_hash")) > 128), "source hash").when(c["revision_number"] < 1, "revision number")
        .when(given("report_type", S.one_of(F.upper(f("report_type")), S.REPORT_TYPES)), "report type").when(~c["fiscal_year"].between(1, 9999), "fiscal year").when(given("fiscal_period", S.is_fiscal_period(f("fiscal_period"))), "fiscal period")
        .when(given("supersedes_filing_id", S.is_identifier(f("supersedes_filing_id"))), "superseded filing").when(given("storage_path", S.is_relative_path(f("storage_path"))), "storage path")
    )


def check_candidates(rows: DataFrame, hosts: list[str]) -> DataFrame:
    """rows (candidate JSON) with the parsed struct ``c`` and ``problem``."""
    parsed = rows.withColumn("c", F.from_json("candidate", CANDIDATE))
    return parsed.withColumn("problem", candidate_problem(F.col("c"), F.col("candidate"), hosts))


def persist_decision(candidates: DataFrame, filings: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """candidates (filing_id, revision_number, supersedes_filing_id) with decision INSERT, REPLAY, or a rejection; superseded filings are looked up in their own table where one is given."""
    known = filings.select("filing_id", F.col("revision_number").alias("stored"))
    prior = (filings if superseded is None else superseded).select(F.col("filing_id").alias("supersedes_filing_id"), F.col("revision_number").alias("prior"))
    r = candidates.join(known, "filing_id", "left").join(prior, "supersedes_filing_id", "left")
    c = F.col
    decision = (
        F.when(c("stored") == c("revision_number"), "REPLAY").when(c("stored").isNotNull(), "REJECT_REVISION_CONFLICT")
        .when(c("supersedes_filing_id").isNotNull() & c("prior").isNull(), "REJECT_SUPERSEDED_UNKNOWN").when(c("prior") >= c("revision_number"), "REJECT_SUPERSEDED_REVISION").otherwise("INSERT")
    )
    return r.select("filing_id", "revision_number", decision.alias("decision"))


def parse_results(texts: DataFrame, column: str = "value") -> DataFrame:
    return texts.select(F.from_json(column, PARSER_RESULT).alias("r")).select("r.*")


def record_sets(results: DataFrame) -> dict[str, DataFrame]:
    """contexts, units, dimensions and facts of parser results as tables."""
    return {n: results.select(F.col("filing_id").alias("result_filing_id"), F.inline(n)) for n in ("contexts", "units", "dimensions", "facts")}


def result_violations(results: DataFrame, contract_version: str) -> DataFrame:
    """(filing_id, violation) of a table of parser results, checked row by row on their arrays."""
    c = F.col
    ids = lambda a, f: F.transform(a, lambda x: x[f])
    arr = lambda n: F.coalesce(n, F.array())
    ctx, unit, dim, fact = (arr(n) for n in ("contexts", "units", "dimensions", "facts"))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    known = ids(ctx, "context_id")
    checks = {
        "contract": (c("parser_contract") != "xbrl_parser_result") | (c("parser_contract_version") != contract_version),
        "status": c("status") != "SUCCESS",
        **{f"count of {n}": ~c("counts")[n].eqNullSafe(F.size(a)) for n, a in (("contexts", ctx), ("units", unit), ("dimensions", dim), ("facts", fact))},
        **{f"duplicate {n}": F.size(F.array_distinct(ids(a, k))) != F.size(a) for n, a, k in (("contexts", ctx, "context_id"), ("units", unit, "unit_id"), ("dimensions", dim, "dimension_id"), ("facts", fact, "raw_fact_id"))},
        "dimension context": F.exists(dim, lambda x: ~F.array_contains(known, x["context_id"])),
        "fact context": F.exists(fact, lambda x: ~F.array_contains(known, x["context_ref"])),
        "fact unit": F.exists(fact, lambda x: x["unit_ref"].isNotNull() & ~F.array_contains(ids(unit, "unit_id"), x["unit_ref"])),
        "fact value": F.exists(fact, lambda x: ~F.coalesce(x["is_nil"], F.lit(False)) & blank(x["raw_value"])),
        "fact status": F.exists(fact, lambda x: ~F.coalesce(x["fact_status"].isin("EXTRACTED", "PARSE_ERROR"), F.lit(False))),
        "period type": F.exists(ctx, lambda x: ~F.coalesce(x["period_type"].isin("INSTANT", "DURATION", "FOREVER"), F.lit(False))),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), name) for name, cond in checks.items()]))
    return results.select("filing_id", F.explode(found).alias("violation"))


def artifact_catalog(files: DataFrame, most_bytes: int, extensions: tuple[str, ...]) -> DataFrame:
    """files (filing_id, artifact_type, filename, content or source_hash and size_bytes) checked and one row per (filing, type, hash), with its storage path."""
    if "content" in files.columns:
        files = files.withColumn("source_hash", F.sha2("content", 256)).withColumn("size_bytes", F.octet_length("content").cast("bigint")).drop("content")
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    good = files.where(F.col("size_bytes").between(1, most_bytes) & F.col("filename").isNotNull() & extension.isin("", *extensions))
    one = good.groupBy("filing_id", "artifact_type", "source_hash").agg(F.min("filename").alias("filename"), F.first("size_bytes").alias("size_bytes"))
    return one.withColumn("storage_path", F.concat_ws("/", F.lit("filings"), "filing_id", F.lower("artifact_type"), "source_hash", "filename"))


def corrupt_artifacts(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog rows whose file now has another hash, or is gone."""
    now = files.select("artifact_id", F.col("source_hash").alias("found"))
    return catalog.join(now, "artifact_id", "left").where(~F.col("source_hash").eqNullSafe(F.col("found"))).select("artifact_id", "source_hash", "found")


def discover(rows: DataFrame, hosts: list[str], order: str, issuer: str | None = None, offset: int = 0, page_size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) candidates of rows (candidate, ``order``): a page of the good ones of an issuer in order, and all bad ones.

    Offsets count accepted candidates. Bounds outside of 1 to 1,000 rows, and issuers that are no codes, are refused before any job.
    """
    if not 1 <= page_size <= 1000 or offset < 0:
        raise ValueError("a page has 1 to 1,000 candidates and a positive offset")
    issuer = issuer.strip().upper() if issuer is not None else None
    if issuer is not None and not re.fullmatch(r"[A-Z0-9.-]{1,32}", issuer):
        raise ValueError("not an issuer code")
    checked = check_candidates(rows, hosts)
    good = checked.where(F.col("problem").isNull())
    if issuer is not None:
        good = good.where(F.upper(F.trim("c.issuer_code")) == issuer)
    return good.orderBy(order).offset(offset).limit(page_size), checked.where(F.col("problem").isNotNull())


def candidate_files(spark: SparkSession, path: str, most_bytes: int = 5 << 20, most_candidates: int = 1000) -> DataFrame:
    """(path, size, candidates, problem): each candidate file held against the bounds before its candidates are used."""
    texts = spark.read.option("wholetext", True).text(path).select("value", "_metadata.file_path", "_metadata.file_size")
    bare = F.try_parse_json("value")
    list_ = F.coalesce(F.try_variant_get(bare, "$", "array<variant>"), F.try_variant_get(bare, "$.candidates", "array<variant>"))
    n = F.size(list_).cast("bigint")
    problem = F.when(F.col("file_size") > most_bytes, "too many bytes").when(bare.isNull(), "not JSON").when(list_.isNull(), "no candidate list").when(n > most_candidates, "too many candidates")
    return texts.select(F.col("file_path").alias("path"), F.col("file_size").alias("size"), n.alias("candidates"), problem.alias("problem"))
