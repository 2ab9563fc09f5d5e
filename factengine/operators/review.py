"""Mapping review: impact, inventory, new versions, reprocessing and review marks as batch decisions."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import ids, scalars as S
from .latest import latest


def mapping_impact(facts: DataFrame, mappings: DataFrame) -> DataFrame:
    """(mapping_rule_id, filing_id): filings with a fact the mapping reads; nulls and blanks in a mapping are wildcards."""
    c = F.col
    m = mappings.select("mapping_rule_id", c("source_concept").alias("m_concept"), c("entry_point").alias("m_entry"), F.coalesce("source_namespace", F.lit("")).alias("m_namespace"), S.listed(F.coalesce("allowed_scope", F.lit(""))).alias("m_scopes"), c("period_type").alias("m_period"))
    on = (
        (c("source_concept") == c("m_concept"))
        & (c("m_entry").isNull() | (c("m_entry") == c("entry_point")))
        & ((c("m_namespace") == "") | (c("m_namespace") == c("source_namespace")))
        & ((F.size("m_scopes") == 0) | F.array_contains("m_scopes", c("scope")))
        & (c("m_period").isNull() | (c("m_period") == c("period_type")))
    )
    shapes = facts.select("filing_id", "source_concept", "entry_point", "source_namespace", "scope", "period_type").distinct()
    return shapes.join(m, on).select("mapping_rule_id", "filing_id").distinct()


def evidence_problems(asked: DataFrame, owners: DataFrame) -> DataFrame:
    """asked (.., e, concept) with ``problem``: unknown evidence, or another concept's."""
    found = asked.join(owners, "e", "left")
    problem = F.when(F.col("owner").isNull(), "EVIDENCE_NOT_FOUND").when(F.col("owner") != F.col("concept"), "EVIDENCE_NOT_OWNED")
    return found.withColumn("problem", problem)


def inventory(mappings: DataFrame, raw_series: DataFrame, affected: DataFrame) -> DataFrame:
    """Series with current mapping, status (UNMAPPED for raw series without one) and affected filings; one plan for all series."""
    now = latest(mappings, ["series_key"], F.desc("rule_version"), F.asc("mapping_rule_id"))
    now = now.join(affected, "mapping_rule_id", "left").select("series_key", "source_concept", "entry_point", "mapping_rule_id", F.col("status").alias("display_status"), F.coalesce("filings", F.lit(0)).cast("bigint").alias("filings"))
    rest = raw_series.join(now, "series_key", "left_anti").select("series_key", "source_concept", "entry_point", F.lit(None).cast("string").alias("mapping_rule_id"), F.lit("UNMAPPED").alias("display_status"), F.lit(0).cast("bigint").alias("filings"))
    return now.unionByName(rest)


def create_versions(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """requests (request_id, series_key, source_namespace, source_concept, entry_point, expected_version) with code (null: accepted), rule_version and supersedes."""
    c = F.col
    now = latest(mappings, ["series_key"], F.desc("rule_version"), F.desc("mapping_rule_id")).select("series_key", c("rule_version").alias("now"), c("mapping_rule_id").alias("supersedes"))
    r = requests.withColumn("derived", ids.series_key(c("source_namespace"), c("source_concept"), c("entry_point"))).join(now, "series_key", "left")
    code = F.when(c("derived") != c("series_key"), "MAPPING_SERIES_MISMATCH").when(~c("expected_version").eqNullSafe(c("now")), "MAPPING_VERSION_STALE")
    r = r.withColumn("code", code)
    # of several good requests for one series the first wins
    winner = r.where(c("code").isNull()).groupBy("series_key").agg(F.min("request_id").alias("winner"))
    late = c("code").isNull() & (c("request_id") != c("winner"))
    r = r.join(winner, "series_key", "left").withColumn("code", F.when(late, "MAPPING_VERSION_CONFLICT").otherwise(c("code")))
    return r.select("request_id", "series_key", "code", F.when(c("code").isNull(), F.coalesce("now", F.lit(0)) + 1).alias("rule_version"), F.when(c("code").isNull(), c("supersedes")).alias("supersedes"))


def reprocess(requests: DataFrame, mappings: DataFrame, impact: DataFrame, raw: DataFrame, running: DataFrame) -> DataFrame:
    """requests (mapping_rule_id, filing_id, expected_version) with code (null: accepted)."""
    flag = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    r = requests.join(mappings.select("mapping_rule_id", "rule_version", "status"), "mapping_rule_id", "left")
    r = r.join(flag(impact, ["mapping_rule_id", "filing_id"], "inside"), ["mapping_rule_id", "filing_id"], "left").join(flag(raw, ["filing_id"], "has_raw"), "filing_id", "left").join(flag(running, ["filing_id"], "active"), "filing_id", "left")
    c = F.col
    code = (
        F.when(c("rule_version").isNull(), "MAPPING_SERIES_NOT_FOUND").when(c("rule_version") != c("expected_version"), "MAPPING_SET_VERSION_STALE").when(c("status") != "APPROVED", "MAPPING_NOT_APPROVED")
        .when(c("inside").isNull(), "FILING_OUTSIDE_IMPACT").when(c("has_raw").isNull(), "PREREQUISITE_MISSING").when(c("active").isNotNull(), "ACTIVE_OPERATION")
    )
    return r.select("mapping_rule_id", "filing_id", code.alias("code"))


def mark_reviews(requests: DataFrame, entities: DataFrame, open_items: DataFrame) -> DataFrame:
    """requests (request_id, entity_type, entity_id, filing_id, expected_version, idempotency_key, rationale) with decision CREATED, REPLAYED or a code."""
    c = F.col
    e = entities.select("entity_type", "entity_id", c("filing_id").alias("owner"), "version")
    o = open_items.select("entity_type", "entity_id", "filing_id", c("idempotency_key").alias("o_key"), c("rationale").alias("o_rationale"))
    r = requests.join(e, ["entity_type", "entity_id"], "left").join(o, ["entity_type", "entity_id", "filing_id"], "left")
    decision = (
        F.when(~c("entity_type").isin("normalized_fact", "validation_result"), "REVIEW_ENTITY_TYPE_UNSUPPORTED").when(~c("owner").eqNullSafe(c("filing_id")), "REVIEW_ENTITY_NOT_OWNED")
        .when(c("version") != c("expected_version"), "REVIEW_VERSION_STALE").when((c("o_key") == c("idempotency_key")) & (c("o_rationale") == F.trim("rationale")), "REPLAYED").when(c("o_key").isNotNull(), "REVIEW_ITEM_EXISTS").otherwise("CREATED")
    )
    return r.select("request_id", decision.alias("decision"))


def fact_detail(facts: DataFrame, filings: DataFrame, raw: DataFrame, contexts: DataFrame, units: DataFrame, mappings: DataFrame, concepts: DataFrame) -> DataFrame:
    """facts (raw_fact_id, filing_id, canonical_concept, mapping_rule_id, ..) with filing, raw_fact, context, unit, mapping and concept as structs.

    Every join is a left one, so a fact without any of them stays, with a null struct.
    Mappings and concepts are reference data, which Spark broadcasts where their size allows it.
    """
    whole = lambda df, name, key: df.select(*key, F.struct("*").alias(name))
    r = raw.select("raw_fact_id", "context_id", "unit_id", F.struct("raw_fact_id", "source_concept", "source_namespace", "raw_value", "is_nil").alias("raw_fact"))
    out = facts.join(r, "raw_fact_id", "left").join(whole(contexts, "context", ["context_id"]), "context_id", "left").join(whole(units, "unit", ["unit_id"]), "unit_id", "left")
    out = out.join(whole(filings, "filing", ["filing_id"]), "filing_id", "left").join(whole(mappings, "mapping", ["mapping_rule_id"]), "mapping_rule_id", "left")
    return out.join(concepts.select(F.col("code").alias("canonical_concept"), F.struct("*").alias("concept")), "canonical_concept", "left")


def validation_detail(results: DataFrame, facts: DataFrame, filings: DataFrame) -> DataFrame:
    """results with input_facts, the filing's own facts among their evidence, and the filing; foreign evidence is left out.

    Facts and results are grouped by filing once each, and a filing's results take their facts from its array.
    """
    item = F.struct("normalized_fact_id", "canonical_concept", F.col("value").cast("string").alias("value"), "currency", "source_concept")
    owned = facts.groupBy("filing_id").agg(F.array_sort(F.collect_list(item)).alias("owned"))
    rest = [c for c in results.columns if c != "filing_id"]
    judged = results.groupBy("filing_id").agg(F.collect_list(F.struct(*rest)).alias("judged"))
    head = filings.select("filing_id", F.struct("filing_id", "issuer_code", "fiscal_period", "revision_number").alias("filing"))
    own = lambda r: F.filter("owned", lambda x: F.array_contains(r["evidence"], x["normalized_fact_id"]))
    detailed = F.transform("judged", lambda r: F.struct(*[r[c].alias(c) for c in rest], own(r).alias("input_facts")))
    out = judged.join(owned, "filing_id", "left").join(head, "filing_id", "left")
    return out.select("filing_id", F.explode(detailed).alias("r"), "filing").select("filing_id", "r.*", "filing")


def told_detail(told: DataFrame) -> DataFrame:
    """(filing_id, r, filing) of told rows (filing_id, outcomes, facts and the filing's columns): r is (rule_code, rule_version, o, severity, input_facts) as of validation_detail; both lie in the filing's row already."""
    head = F.struct("filing_id", "issuer_code", "fiscal_period", "revision_number").alias("filing")
    own = lambda r: F.filter("facts", lambda x: F.array_contains(r["o"]["evidence"], x["normalized_fact_id"]))
    detailed = F.transform("outcomes", lambda r: F.struct(*[r[c].alias(c) for c in ("rule_code", "rule_version", "o", "severity")], F.when(F.size(r["o"]["evidence"]) > 0, own(r)).alias("input_facts")))
    rows = told.select("filing_id", F.explode_outer(detailed).alias("r"), head)
    return rows.where(F.col("r").isNotNull())


def series_history(mappings: DataFrame) -> DataFrame:
    """mappings with ``place`` in their series, newest version first, and ``versions``, the series' number of them."""
    w = W.partitionBy("series_key")
    place = F.row_number().over(w.orderBy(F.desc("rule_version"), F.asc("mapping_rule_id")))
    return mappings.withColumns({"place": place.cast("bigint"), "versions": F.count("*").over(w)})
