"""Raw facts to canonical facts. The mappings of a concept are one array, joined to its facts, so a fact is judged in its own row and facts are not shuffled again."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids, scalars as S
from .latest import at_latest_version

#: Codes of why a fact is not normalized, in the order in which they are tested.
REASONS = ("NO_MAPPING", "NOT_APPROVED", "SCOPE_DIFFERS", "PERIOD_DIFFERS", "CONTEXT_DIFFERS", "AMBIGUOUS", "UNKNOWN_CONCEPT", "BAD_NUMBER", "BAD_SIGN_CONVENTION", "BAD_EXCEPTION_VALUE")


#: A mapping's columns that its fact takes over, the deciding one first.
PICKED = ("mapping_rule_id", "rule_version", "canonical_concept", "sign_convention", "d_known")


def current_mappings(mappings: DataFrame) -> DataFrame:
    """Mappings at the latest version of their series; a newer draft hides an older approved one."""
    key = ids.series_key(F.col("source_namespace"), F.col("source_concept"), F.col("entry_point"))
    return at_latest_version(mappings.withColumn("series_key", key), ["source_concept", "series_key"], "rule_version")


def _prepared(mappings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mappings with trimmed filter values (blank: any) and the dictionary's entry of their concept."""
    c = F.col
    d = dictionary.select(c("code").alias("d_code"), S.listed(c("allowed_scope")).alias("d_scopes"), F.upper(F.trim("period_type")).alias("d_period"))
    blank = F.trim(F.coalesce("entry_point", F.lit(""))) == ""
    return mappings.join(d, c("canonical_concept") == c("d_code"), "left").select(
        "mapping_rule_id", c("source_concept").alias("m_concept"), F.trim(F.coalesce("source_namespace", F.lit(""))).alias("m_namespace"), "canonical_concept",
        F.when(~blank, F.trim("entry_point")).alias("m_entry"), S.listed(F.upper(F.coalesce("allowed_scope", F.lit("")))).alias("m_scopes"),
        F.upper(F.trim(F.coalesce("period_type", F.lit("")))).alias("m_period"), "sign_convention", F.upper("status").alias("m_status"), "rule_version",
        F.upper(F.trim(F.coalesce("dimension_policy", F.lit("UNDIMENSIONED_ONLY")))).alias("m_policy"), c("d_code").isNotNull().alias("d_known"), "d_scopes", "d_period",
    )


def _in_namespace(m) -> Column:
    """Whether a mapping, whose columns ``m`` gives by name, takes the fact's namespace."""
    return (m("m_namespace") == "") | (m("m_namespace") == F.trim(F.coalesce("source_namespace", F.lit(""))))


def _flags(m) -> dict[str, Column]:
    """What a mapping, whose columns ``m`` gives by name, says of the fact at each filter level."""
    scope, period = F.upper(F.coalesce("scope", F.lit(""))), F.upper(F.coalesce("period_type", F.lit("")))
    in_scopes = lambda s: F.coalesce(F.size(s) == 0, F.lit(True)) | F.coalesce(F.array_contains(s, scope), F.lit(False))
    in_period = lambda p: F.coalesce(p.isin("", "ANY") | (p == period), F.lit(True))
    fits_scope, fits_period = in_scopes(m("m_scopes")), F.coalesce((m("m_period") == "") | (m("m_period") == period), F.lit(True))
    fits = ~((m("m_policy") == "UNDIMENSIONED_ONLY") & F.coalesce("dimensioned", F.lit(False)))
    fits = fits & (m("m_entry").isNull() | F.coalesce(m("m_entry") == F.trim("entry_point"), F.lit(False)))
    fits = fits & fits_scope & in_scopes(m("d_scopes")) & in_period(m("m_period")) & in_period(m("d_period"))
    approved = F.coalesce(m("m_status") == "APPROVED", F.lit(False))
    return {"approved": approved, "applies": approved & fits, "fits_scope": fits_scope, "fits_period": fits_period}


def candidates(facts: DataFrame, mappings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Facts with every mapping of their concept and namespace (left join), and flags ``approved`` and ``applies``.

    ``source_concept`` stays the equi key, so blank wildcards are a residual condition.
    Mappings and dictionary are reference data of a few thousand rows; Spark
    broadcasts them where their size allows it.
    """
    c = F.col
    m = _prepared(mappings, dictionary).withColumn("d_scopes", F.transform("d_scopes", F.upper))
    return facts.join(m, (c("source_concept") == c("m_concept")) & _in_namespace(c), "left").withColumns(_flags(c))


def normalize(facts: DataFrame, mappings: DataFrame, dictionary: DataFrame, version: str = "v1", exceptions: list[tuple[str, Column, Column]] = ()) -> DataFrame:
    """One row per raw fact: status NORMALIZED, UNMAPPED or REVIEW_REQUIRED with reason, and the canonical fact.

    facts: raw_fact_id, filing_id, source_concept, source_namespace, raw_value, is_nil, entry_point, scope,
    period_type, start_date, end_date, instant_date, dimensioned, unit_currency, fiscal_period.
    ``exceptions`` are (code@version, condition, value) applied in order after the sign; the condition may use the
    mapping's columns and the value ``value``.
    """
    c = F.col
    m = _prepared(mappings, dictionary).where(c("mapping_rule_id").isNotNull()).withColumn("d_scopes", F.transform("d_scopes", F.upper))
    of_concept = m.groupBy("m_concept").agg(F.collect_list(F.struct(*[x for x in m.columns if x != "m_concept"])).alias("of_concept"))
    judged = lambda x: F.struct(*[x[k].alias(k) for k in PICKED], *[v.alias(k) for k, v in _flags(lambda k: x[k]).items()])
    found = F.transform(F.filter(F.coalesce("of_concept", F.array()), lambda x: _in_namespace(lambda k: x[k])), judged)
    one = facts.join(of_concept, c("source_concept") == c("m_concept"), "left").withColumn("found", found)
    having = lambda flag: F.filter("found", lambda x: x[flag])
    least = lambda flag, *parts: F.array_min(F.transform(having(flag), lambda x: F.struct(*[p(x) for p in parts])))
    named = lambda k: lambda x: x[k].alias(k)
    one = one.withColumns({
        "n_cand": F.size("found"), "n_appr": F.size(having("approved")), "n_appl": F.size(having("applies")), "m": least("applies", *map(named, PICKED)),
        "ok": least("approved", lambda x: (-x["rule_version"]).alias("newest"), *map(named, ("mapping_rule_id", "fits_scope", "fits_period"))),
    })
    null = F.lit(None).cast("string")
    text = S.numeric_text(c("is_nil"), null, c("raw_value"))
    bad = S.invalid_number(c("is_nil"), null, c("raw_value")) | (text.isNotNull() & S.decimal_of(text).isNull())
    out = one.withColumn("value", S.signed(S.decimal_of(text), c("m.sign_convention")))
    used, wrong = F.array().cast("array<string>"), F.lit(False)
    for i, (name, condition, value) in enumerate(exceptions):
        # columns of their own: what they read is the value before this exception
        hit, changed = F.coalesce(condition, F.lit(False)), value.try_cast(S.DECIMAL)
        out = out.withColumns({f"_hit{i}": hit, f"_changed{i}": changed, f"_wrong{i}": hit & value.isNotNull() & changed.isNull()})
        out = out.withColumn("value", F.when(c(f"_hit{i}"), c(f"_changed{i}")).otherwise(c("value")))
        wrong = wrong | c(f"_wrong{i}")
        used = F.when(c(f"_hit{i}"), F.array_append(used, F.lit(name))).otherwise(used)
    out = out.withColumn("exception_versions", F.when(F.size(used) == 0, "NONE").otherwise(F.array_join(used, ",")))
    r = [F.lit(x) for x in REASONS]
    reason = (
        F.when(c("n_cand") == 0, r[0]).when(c("n_appr") == 0, r[1])
        .when(c("n_appl") == 0, F.when(~c("ok.fits_scope"), r[2]).when(~c("ok.fits_period"), r[3]).otherwise(r[4]))
        .when(c("n_appl") > 1, r[5]).when(~c("m.d_known"), r[6]).when(bad, r[7]).when(text.isNotNull() & ~S.known_sign(c("m.sign_convention")), r[8]).when(wrong, r[9])
    )
    out = out.withColumn("reason", reason)
    good = c("reason").isNull()
    status = F.when(good, "NORMALIZED").when(c("n_cand") == 0, "UNMAPPED").otherwise("REVIEW_REQUIRED")
    start, end = S.fact_period(c("period_type"), c("start_date"), c("end_date"), c("instant_date"))
    only = lambda x: F.when(good, x)
    rule, rule_version = only(c("m.mapping_rule_id")), only(c("m.rule_version"))
    out = out.select(
        "raw_fact_id", "filing_id", "source_concept", status.alias("status"), "reason", only(c("m.canonical_concept")).alias("canonical_concept"), only(c("value")).alias("value"),
        only(c("scope")).alias("scope"), only(c("fiscal_period")).alias("period"), only(start).alias("period_start"), only(end).alias("period_end"), only(c("unit_currency")).alias("currency"),
        rule.alias("mapping_rule_id"), rule_version.alias("mapping_rule_version"), only(c("exception_versions")).alias("exception_versions"),
        S.availability(c("is_nil"), c("value"), good).alias("availability"), F.lit(version).alias("normalization_version"),
    )
    new = ids.normalized_fact_id("filing_id", "raw_fact_id", "mapping_rule_id", "mapping_rule_version", "normalization_version", "exception_versions")
    issue = ids.issue_id("filing_id", "raw_fact_id", "normalization_version", "status", "reason")
    return out.withColumn("record_id", F.when(F.col("status") == "NORMALIZED", new).otherwise(issue))


def resolve_metadata(facts: DataFrame) -> DataFrame:
    """(filing_id, scope, currency, status, evidence) from each filing's DEI facts; facts: filing_id, raw_fact_id, source_namespace, source_concept, raw_value, source_context_id, unit_currency."""
    c = F.col
    dei = F.lower(F.coalesce("source_namespace", F.lit(""))).endswith("/dei")
    best = F.struct((c("source_context_id") != "CurrentYearInstant"), c("raw_fact_id"))
    first = lambda concept: F.min_by(F.struct("raw_fact_id", "raw_value"), F.when(dei & (c("source_concept") == concept), best))
    out = facts.groupBy("filing_id").agg(
        first("WhetherTheFinancialStatementsAreOfAnIndividualEntityOrAGroupOfEntities").alias("s"), first("DescriptionOfPresentationCurrency").alias("p"),
        F.collect_set(F.upper("unit_currency")).alias("units"),
    )
    out = out.withColumns({"scope": S.scope_of(c("s.raw_value")), "currency": S.currency_of(c("p.raw_value"))})
    clash = c("currency").isNotNull() & F.exists("units", lambda u: u != c("currency"))
    status = F.when(F.coalesce(clash, F.lit(False)) | (c("scope") == "UNKNOWN"), "REVIEW_REQUIRED").otherwise("RESOLVED")
    return out.select("filing_id", "scope", "currency", status.alias("status"), F.concat_ws(",", "s.raw_fact_id", "p.raw_fact_id").alias("evidence"))


def _resolved(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("status") == "RESOLVED").select("filing_id", F.col("scope").alias("own_scope"), F.col("currency").alias("own_currency"))


def stamped_facts(facts: DataFrame, metadata: DataFrame) -> DataFrame:
    """facts whose contexts have the scope of their filing's metadata (resolve_metadata), where these are resolved."""
    out = facts.join(_resolved(metadata), "filing_id", "left")
    return out.withColumn("scope", F.coalesce("own_scope", "scope")).select(*facts.columns)


def stamped_filings(filings: DataFrame, metadata: DataFrame) -> DataFrame:
    """filings with the scope and the presentation currency of their metadata, where these are resolved; an unknown currency changes nothing."""
    out = filings.join(_resolved(metadata), "filing_id", "left")
    return out.withColumns({"scope": F.coalesce("own_scope", "scope"), "presentation_currency": F.coalesce("own_currency", "presentation_currency")}).select(*filings.columns)


def zero_issues(stored: DataFrame) -> DataFrame:
    """(filing_id, raw_fact_id, reason) of stored facts that are nil and have the value zero; stored: filing_id, raw_fact_id, is_nil, value."""
    return stored.where(F.col("is_nil") & (F.col("value") == 0)).select("filing_id", "raw_fact_id", F.lit("NIL_BECAME_ZERO").alias("reason"))
