"""Checks of reference data before an import: every violation as a row, and a report of their numbers."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

LEAST_CONCEPTS = 30
#: Values that reference data may have (fixed values of the files' format).
PERIOD_TYPES = ("instant", "duration")
SCOPES = ("group", "single")
REQUIREDNESS = ("required", "optional")
SIGN_CONVENTION = "source sign"
STATEMENTS = ("balance_sheet", "cash_flow", "income_statement")
MAPPING_STATUSES = ("PROPOSED", "CONFIRMED", "REVIEW_REQUIRED", "REJECTED")


def _offences(rows: DataFrame, key: Column, checks: dict[str, Column]) -> DataFrame:
    """(check, id) of each row and check whose condition does not hold; a null condition does not."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in checks.items()]))
    return rows.select(F.explode(found).alias("check"), key.cast("string").alias("id"))


def dictionary_violations(dictionary: DataFrame, least: int = LEAST_CONCEPTS, statements: tuple[str, ...] = STATEMENTS) -> DataFrame:
    """dictionary: canonical_concept, statement, period_type, sign_convention, allowed_scope, required."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    scopes = F.array_sort(F.array_distinct(S.listed(F.col("allowed_scope"))))
    each = _offences(dictionary, F.col("canonical_concept"), {
        "PERIOD_TYPE_UNKNOWN": text("period_type").isin(*PERIOD_TYPES), "SIGN_CONVENTION_UNKNOWN": text("sign_convention") == SIGN_CONVENTION,
        "SCOPES_UNLIKE_BOTH": scopes == F.array(*map(F.lit, SCOPES)), "REQUIREDNESS_UNKNOWN": text("required").isin(*REQUIREDNESS), "CONCEPT_NAMELESS": text("canonical_concept") != "",
    })
    whole = dictionary.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("statement").isin(*statements), F.col("statement"))).alias("there"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, statements)), F.col("there")), lambda s: F.struct(F.lit("STATEMENT_MISSING").alias("check"), s.alias("id")))
    small = F.when(F.col("n") < least, F.array(F.struct(F.lit("DICTIONARY_TOO_SMALL").alias("check"), F.col("n").cast("string").alias("id")))).otherwise(F.array())
    return each.unionAll(whole.select(F.explode(F.concat(missing, small)).alias("v")).select("v.*"))


def mapping_violations(mappings: DataFrame, dictionary: DataFrame, facts: DataFrame, entry_points: DataFrame) -> DataFrame:
    """mappings: source_concept, concept_namespace, entry_point (a ;-list), canonical_concept, status; facts: source_concept, concept_namespace; entry_points: entry_point.

    The joins are by key, so each side may be large; an id is namespace#concept.
    """
    c = F.col
    flag = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    key = ["source_concept", "concept_namespace"]
    times = mappings.groupBy(*key).agg(F.count("*").alias("times"))
    rows = mappings.join(flag(dictionary, ["canonical_concept"], "has_concept"), "canonical_concept", "left").join(flag(facts, key, "has_source"), key, "left").join(times, key, "left")
    name = F.concat_ws("#", "concept_namespace", "source_concept")
    each = _offences(rows, name, {
        "MAPPING_CONCEPT_UNKNOWN": c("has_concept"), "MAPPING_SOURCE_ABSENT": c("has_source"), "MAPPING_STATUS_UNKNOWN": F.trim("status").isin(*MAPPING_STATUSES), "MAPPING_REPEATED": c("times") == 1,
    })
    points = mappings.select(name.alias("id"), F.explode(F.array_distinct(S.listed(c("entry_point")))).alias("entry_point"))
    unknown = points.join(flag(entry_points, ["entry_point"], "known"), "entry_point", "left").where(c("known").isNull())
    return each.unionAll(unknown.select(F.lit("MAPPING_ENTRY_POINT_UNKNOWN"), "id").distinct())


def report(violations: DataFrame, sizes: dict[str, DataFrame]) -> DataFrame:
    """(check, n): rows of each table by name, and violations by check."""
    out = violations.groupBy("check").agg(F.count("*").alias("n"))
    for name, df in sizes.items():
        out = out.unionAll(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n"))
    return out


def import_plan(rows: DataFrame, stored: DataFrame, key: list[str], values: list[str], violations: DataFrame, name: Column) -> DataFrame:
    """rows with ``decision`` and ``checks``: what an import would do with each, without doing it.

    REFUSED with the checks that a row violates (violations: check, id; ``name`` is a row's id in them), else UNCHANGED or
    NEW_VERSION where its key is stored with the same or other values, else NEW. Stored keys are distinct.
    """
    c = F.col
    digest = lambda: F.xxhash64(*[F.coalesce(c(v).cast("string"), F.lit("\x00")) for v in values])
    refused = violations.groupBy(c("id").alias("_name")).agg(F.array_sort(F.collect_set("check")).alias("checks"))
    known = stored.select(*key, digest().alias("_stored"))
    out = rows.withColumns({"_name": name.cast("string"), "_own": digest()}).join(refused, "_name", "left").join(known, key, "left")
    decision = F.when(c("checks").isNotNull(), "REFUSED").when(c("_stored").isNull(), "NEW").when(c("_stored") == c("_own"), "UNCHANGED").otherwise("NEW_VERSION")
    return out.withColumns({"decision": decision, "checks": F.coalesce("checks", F.array().cast("array<string>"))}).drop("_name", "_own", "_stored")


def to_import(plan: DataFrame) -> DataFrame:
    """The rows of a plan that an import writes."""
    return plan.where(F.col("decision").isin("NEW", "NEW_VERSION")).drop("decision", "checks")
