"""The twenty quality rules, over all filings at once.

Every rule is a Column over one wide row per filing, so a run is one grouped scan
of the facts, a narrow second one for the cross-period rules and one explode. ``service``
follows the exact-decimal engine, ``batch`` the audit script; they differ where
inputs are missing.

A result is struct(result, severity, message, expected, actual, evidence).
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S

TOLERANCE = S.TOLERANCE
DECIMAL = S.DECIMAL
CONCEPTS = [
    "total_assets", "current_assets", "non_current_assets", "total_liabilities", "current_liabilities", "non_current_liabilities", "total_equity",
    "equity_parent", "non_controlling_interests", "temporary_syirkah_funds", "revenue", "cost_of_revenue", "gross_profit", "profit_loss",
    "profit_loss_parent", "profit_loss_nci", "cash_flow_operating", "cash_flow_investing", "cash_flow_financing", "net_change_cash",
    "cash_and_cash_equivalents", "ending_cash_cash_flow",
]
COMPARED = ["total_assets", "total_liabilities", "total_equity", "revenue", "profit_loss"]
RESULT = f"struct<result:string,severity:string,message:string,expected:{DECIMAL},actual:{DECIMAL},evidence:array<string>>"


def outcome(result: str, severity: str, message: str, expected: Column | None = None, actual: Column | None = None, evidence: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(result).alias("result"), F.lit(severity).alias("severity"), F.lit(message).alias("message"),
        (null if expected is None else expected).cast(DECIMAL).alias("expected"), (null if actual is None else actual).cast(DECIMAL).alias("actual"),
        (F.array().cast("array<string>") if evidence is None else evidence).alias("evidence"),
    )


def passed(message: str, **more) -> Column:
    return outcome("PASS", "INFO", message, **more)


def failed(message: str, **more) -> Column:
    return outcome("FAIL", "ERROR", message, **more)


def review(message: str, **more) -> Column:
    return outcome("REVIEW_REQUIRED", "WARN", message, **more)


def skipped(message: str) -> Column:
    return outcome("SKIPPED", "INFO", message)


def _ids(*concepts: str, reported: tuple[str, ...] = ()) -> Column:
    """Ids of the filing's facts of these concepts, and of those of ``reported`` that have a value."""
    def named(x: Column) -> Column:
        own = x["canonical_concept"].isin(*concepts)
        for c in reported:
            own = own | ((x["canonical_concept"] == c) & F.col(c).isNotNull())
        return own

    return F.transform(F.filter("owned", named), lambda x: x["normalized_fact_id"])


def compared(actual: Column, expected: Column, message: str, evidence: Column | None = None) -> Column:
    """PASS or FAIL by the absolute difference."""
    more = {"expected": expected, "actual": actual, "evidence": evidence}
    return F.when(S.within_tolerance(actual, expected), passed(message, **more)).otherwise(failed(message, **more))


def always() -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Rule:
    """A quality rule. ``applies`` and ``evaluate`` build Columns over the wide row; neither is a row function."""

    code: str
    evaluate: Callable[[str], Column]
    version: int = 1
    applies: Callable[[], Column] = always


def _has(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def _finance(mode: str) -> Column:
    point = F.lower(F.coalesce("entry_point", F.lit("")))
    return point.contains("financesharia") if mode == "service" else point.rlike("sharia|finance")


def _dec(x: Column) -> Column:
    return x.cast(DECIMAL)


def acc_001(mode: str) -> Column:
    c = F.col
    funds = F.coalesce("temporary_syirkah_funds", F.lit(0))
    expected = _dec(c("total_liabilities") + c("total_equity") + (F.when(_finance(mode), funds).otherwise(0) if mode == "service" else funds))
    missing = skipped("Total assets, liabilities and equity are needed.") if mode == "service" else failed("Core balance sheet elements are missing.")
    have = _has("total_assets", "total_liabilities", "total_equity")
    return F.when(~have, missing).otherwise(compared(c("total_assets"), expected, "Assets against liabilities and equity.", _ids("total_assets", "total_liabilities", "total_equity", "temporary_syirkah_funds")))


def _equation(total: str, parts: list[str], needed: list[str], message: str) -> Callable[[str], Column]:
    """total = sum of parts. Service counts a missing part as nothing if any part is there; batch needs the ``needed`` ones."""

    def rule(mode: str) -> Column:
        some = F.lit(False)
        for p in parts:
            some = some | F.col(p).isNotNull()
        have = _has(total) & (some if mode == "service" else _has(*needed))
        expected = _dec(sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))
        return F.when(~have, skipped("Attribution inputs are not fully reported.")).otherwise(compared(F.col(total), expected, message, _ids(total, reported=tuple(parts))))

    return rule


def _classification(total: str, current: str, other: str, message: str) -> Callable[[str], Column]:
    def rule(mode: str) -> Column:
        unclassified = _finance(mode) & F.col(current).isNull() & F.col(other).isNull()
        return (
            F.when(unclassified, skipped("Unclassified balance sheets are accepted for banks."))
            .when(~_has(total, current, other), skipped("The classification is not fully reported."))
            .otherwise(compared(F.col(total), _dec(F.col(current) + F.col(other)), message, _ids(total, current, other)))
        )

    return rule


def hry_004(mode: str) -> Column:
    exempt = _finance(mode) | F.lower(F.coalesce("entry_point", F.lit(""))).contains("infrastructure") if mode == "service" else F.lit(False)
    names = ("gross_profit", "revenue", "cost_of_revenue")
    return (
        F.when(exempt, skipped("Gross profit does not apply to this entry point."))
        .when(~_has(*names), skipped("Gross profit inputs are not fully reported."))
        .otherwise(compared(F.col("gross_profit"), _dec(F.col("revenue") - F.col("cost_of_revenue")), "Gross profit against revenue less cost.", _ids(*names)))
    )


def _offence(flag: str, bad: str, good: str) -> Callable[[str], Column]:
    """FAIL with the first offending fact, which the grouped pass has found."""

    def rule(mode: str) -> Column:
        return F.when(F.col(flag).isNotNull(), failed(bad, evidence=F.array(F.col(flag)))).otherwise(passed(good))

    return rule


def ctx_004(mode: str) -> Column:
    return F.when(F.col("conflicts") > 0, failed("Duplicate facts disagree.", evidence=F.col("conflict_ids"))).otherwise(passed("No duplicate facts disagree."))


def scl_001(mode: str) -> Column:
    declared = F.upper(F.coalesce("presentation_currency", F.lit("")))
    other = (declared != "") & F.exists("currencies", lambda x: x != declared) if mode == "service" else F.lit(False)
    return F.when((F.size("currencies") > 1) | other, failed("Currencies are not uniform with the declared one.")).otherwise(passed("One currency."))


def scl_003(mode: str) -> Column:
    v = F.col("total_assets")
    return F.when(v.isNull(), skipped("Total assets are not reported.")).when(v > 0, passed("Total assets are positive.")).otherwise(failed("Total assets are not positive."))


def scl_004(mode: str) -> Column:
    v = F.col("total_equity")
    return F.when(v.isNull(), skipped("Total equity is not reported.")).when(v < 0, review("Negative equity.")).otherwise(passed("Total equity is not negative."))


def scl_005(mode: str) -> Column:
    a, b = F.col("cash_and_cash_equivalents"), F.col("ending_cash_cash_flow")
    same = a == b if mode == "service" else S.within_tolerance(a, b)
    return F.when(a.isNull() | b.isNull(), skipped("Cash is not reported on both sides.")).when(same, passed("Cash agrees.")).otherwise(review("Cash differs.", expected=a, actual=b))


def crx_001(mode: str) -> Column:
    return (
        F.when(F.col("superseded").isNull(), passed("No superseded filing."))
        .when(~F.col("superseded_known"), review("The superseded filing is unavailable."))
        .when(F.size("changed_ids") > 0, review("Values changed against the superseded filing.", evidence=F.col("changed_ids")))
        .otherwise(passed("Values agree with the superseded filing."))
    )


def crx_002(mode: str) -> Column:
    return (
        F.when(F.col("prior_period").isNull(), passed("No adjacent period is required."))
        .when(F.col("prior_filing").isNull(), review("The adjacent filing is unavailable."))
        .when(F.size("overlap_ids") == 0, skipped("No overlapping concepts."))
        .otherwise(passed("The adjacent period is available.", evidence=F.col("overlap_ids")))
    )


def scp_001(mode: str) -> Column:
    unknown = (F.size("scopes") == 0) | F.array_contains("scopes", "UNKNOWN")
    return F.when(unknown, failed("The reporting scope is unknown.")).when(F.col("bad_scope").isNotNull(), failed("A fact's scope is not permitted by its concept.", evidence=F.array("bad_scope"))).otherwise(passed("The reporting scope is resolved."))


def scp_002(mode: str) -> Column:
    return F.when(F.col("zero_issue"), failed("A nil fact was turned into zero.")).when(F.col("bad_nil").isNotNull(), failed("A nil fact has a value.", evidence=F.array("bad_nil"))).otherwise(passed("Nil facts are preserved."))


RULES = {
    r.code: r
    for r in (
        Rule("ACC-001", acc_001),
        Rule("HRY-001", _equation("total_equity", ["equity_parent", "non_controlling_interests"], ["equity_parent"], "Equity attribution.")),
        Rule("HRY-002", _classification("total_assets", "current_assets", "non_current_assets", "Asset classification.")),
        Rule("HRY-003", _classification("total_liabilities", "current_liabilities", "non_current_liabilities", "Liability classification.")),
        Rule("HRY-004", hry_004),
        Rule("HRY-005", _equation("profit_loss", ["profit_loss_parent", "profit_loss_nci"], ["profit_loss_parent"], "Profit attribution.")),
        Rule("HRY-006", _equation("net_change_cash", ["cash_flow_operating", "cash_flow_investing", "cash_flow_financing"], ["cash_flow_operating", "cash_flow_investing", "cash_flow_financing"], "Cash flow subtotals.")),
        Rule("CTX-001", _offence("bad_dates", "Context dates are wrong.", "Context dates are valid.")),
        Rule("CTX-002", _offence("bad_period_type", "Period types differ.", "Period types agree.")),
        Rule("CTX-003", _offence("bad_dimension", "A dimensioned fact stands among the totals.", "Totals are undimensioned.")),
        Rule("CTX-004", ctx_004),
        Rule("SCL-001", scl_001),
        Rule("SCL-002", _offence("bad_unit", "An EPS unit is not per share.", "EPS units are per share.")),
        Rule("SCL-003", scl_003),
        Rule("SCL-004", scl_004),
        Rule("SCL-005", scl_005),
        Rule("CRX-001", crx_001),
        Rule("CRX-002", crx_002),
        Rule("SCP-001", scp_001),
        Rule("SCP-002", scp_002),
    )
}


def registry(stored: dict[str, int], overrides: dict[str, Rule] | None = None) -> dict[str, Rule]:
    """Rules by code; a code without an implementation, or with another version than stored, fails before any job starts."""
    rules = {**RULES, **(overrides or {})}
    for code, version in stored.items():
        if code not in rules:
            raise LookupError(f"no rule for {code}")
        if rules[code].version != version:
            raise LookupError(f"{code} is implemented as version {rules[code].version}, stored as {version}")
    return {code: rules[code] for code in stored}


def _flags(c: Callable[[str], Column], period: Column, scopes: Column) -> dict[str, Column]:
    """What a fact may offend against; ``c`` names its columns, ``period`` and ``scopes`` are its concept's in the dictionary."""
    start, end = c("period_start"), c("period_end")
    lasting = (period == "DURATION") & (start.isNull() | end.isNull() | (F.month(start) != 1) | (F.dayofmonth(start) != 1) | (start > end))
    own = F.when(start.isNotNull(), "DURATION").otherwise("INSTANT")
    per_share = lambda *cs: F.lower(F.coalesce(*map(c, cs), F.lit(""))).contains("pershares")
    return {
        "bad_dates": lasting | ((period == "INSTANT") & end.isNull()),
        "bad_period_type": period != own,
        "bad_dimension": c("dimensioned"),
        "bad_unit": c("canonical_concept").startswith("eps_") & ~per_share("currency") & ~per_share("unit_ref", "currency"),
        "bad_scope": (F.size(scopes) > 0) & ~F.array_contains(scopes, F.coalesce(c("scope"), F.lit(""))),
        "bad_nil": c("is_nil") & c("value").isNotNull(),
    }


def _fact(c: Callable[[str], Column], period: Column, scopes: Column) -> Column:
    plain = [c(x).alias(x) for x in ("normalized_fact_id", "canonical_concept", "value")]
    return F.struct(*plain, _same(c).alias("same"), F.upper(c("currency")).alias("currency"), c("scope").alias("scope"), *(v.alias(k) for k, v in _flags(c, period, scopes).items()))


def _known(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(F.col("code").alias("canonical_concept"), F.upper(F.trim("period_type")).alias("dict_period"), S.listed(F.col("allowed_scope")).alias("dict_scopes"))


def filing_facts(facts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(filing_id, owned): a filing's facts in id order with what each offends against; the one grouped pass of a rule run."""
    f = facts.join(_known(dictionary), "canonical_concept", "left")
    return f.groupBy("filing_id").agg(F.sort_array(F.collect_list(_fact(F.col, F.col("dict_period"), F.col("dict_scopes")))).alias("owned"))


def known(dictionary: DataFrame) -> DataFrame:
    """One row of one column ``known``: the dictionary, whose codes are unique, as one value, which is as small as the rules' code. A row that has it beside its facts needs no join by concept, which would lose the order of the filings."""
    d = _known(dictionary)
    entry = F.struct("canonical_concept", F.struct(*d.columns[1:]))
    return d.agg(F.map_from_entries(F.collect_list(entry)).alias("known"))


def fact_of(c: Callable[[str], Column], known: Column) -> Column:
    """A fact as filing_facts collects it, whose columns ``c`` gives by name, with ``known`` of the dictionary; for facts that are in one row. ``owned`` has them in id order."""
    d = F.try_element_at(known, c("canonical_concept"))
    return _fact(c, d["dict_period"], d["dict_scopes"])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once for the row. A column that a lambda reads may be put into it by the optimizer, and is then computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _by_concept(facts: Column | str) -> Column:
    """A filing's facts with a value by concept and id."""
    return F.sort_array(F.transform(F.filter(facts, lambda x: x["value"].isNotNull()), lambda x: F.struct(x["canonical_concept"].alias("c"), x["normalized_fact_id"].alias("i"), x["value"].alias("v"))))


def _last(by: Column) -> Column:
    """The last fact of each concept in an array of _by_concept."""
    return let(by, lambda every: F.filter(every, lambda x, i: ~F.get(every, i + 1)["c"].eqNullSafe(x["c"])))


def conflicts(facts: DataFrame) -> DataFrame:
    """(filing_id, conflicts, conflict_ids): groups of one namespace, concept, context and unit with several values, null being one."""
    same = F.struct(*(F.coalesce(c, F.lit("\x00")).alias(c) for c in ("source_namespace", "source_concept", "context_ref", "unit_ref"))).alias("same")
    rows = facts.select("filing_id", "normalized_fact_id", "value", same)
    several = (F.min("value") != F.max("value")) | ((F.count("value") > 0) & (F.count("value") < F.count("*")))
    groups = rows.groupBy("filing_id", "same").agg(several.alias("several")).where("several").select("filing_id", "same")
    ids = rows.join(groups, ["filing_id", "same"], "left_semi").groupBy("filing_id").agg(F.array_sort(F.collect_list("normalized_fact_id")).alias("conflict_ids"))
    return groups.groupBy("filing_id").agg(F.count("*").alias("conflicts")).join(ids, "filing_id")


def listed_conflicts(rows: DataFrame) -> DataFrame:
    """conflicts of rows (filing_id, facts, times): a filing's facts (conflict_fact) are in its one row, and each of them is there ``times`` times."""
    empty = F.array().cast("array<string>")
    shared = F.size(F.array_distinct("facts.same")) < F.size("facts")
    some = only(rows.withColumn("facts", F.when(shared, F.col("facts"))), "facts")
    apart = F.array_distinct(F.array_compact(let(F.sort_array(F.transform("facts", lambda x: F.struct(x["same"].alias("s"), x["value"].alias("v")))), _differing)))
    found = only(some.withColumn("apart", F.coalesce(apart, empty)), "apart")
    named = F.filter("facts", lambda x: F.array_contains("apart", x["same"]))
    ids = F.sort_array(F.flatten(F.transform(named, lambda x: F.array_repeat(x["normalized_fact_id"], F.col("times")))))
    return found.select("filing_id", F.size("apart").cast("bigint").alias("conflicts"), ids.alias("conflict_ids"))


def conflict_fact(f) -> Column:
    """What listed_conflicts reads of a fact, whose columns ``f`` has by name."""
    return F.struct(f["normalized_fact_id"].alias("normalized_fact_id"), f["value"].alias("value"), _same(lambda x: f[x]).alias("same"))


def _same(c: Callable[[str], Column]) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(c(x), F.lit("\x00")) for x in ("source_namespace", "source_concept", "context_ref", "unit_ref")))


def _differing(by: Column) -> Column:
    """Of sorted (s, v) each s that has another v after it, null being one; null for the others."""
    return F.zip_with(by, F.slice(by, 2, F.size(by)), lambda x, y: F.when((x["s"] == y["s"]) & ~x["v"].eqNullSafe(y["v"]), x["s"]))


def restatements(facts: DataFrame) -> DataFrame:
    """A row for each concept whose value differs from the superseded filing's: the restatement events. Of several facts of a concept the last counts."""
    w = W.partitionBy("filing_id", "canonical_concept").orderBy(F.desc("normalized_fact_id"))
    last = facts.where(F.col("value").isNotNull()).withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1)
    new = last.where(F.trim("supersedes_filing_id") != "").select("filing_id", F.col("supersedes_filing_id").alias("superseded_filing_id"), "canonical_concept", F.col("normalized_fact_id").alias("current_fact_id"), F.col("value").alias("current_value"))
    old = last.select(F.col("filing_id").alias("superseded_filing_id"), "canonical_concept", F.col("normalized_fact_id").alias("prior_fact_id"), F.col("value").alias("prior_value"))
    return new.join(old, ["superseded_filing_id", "canonical_concept"]).where(F.col("current_value") != F.col("prior_value"))


def adjacent(filings: DataFrame) -> DataFrame:
    """(filing_id, prior_period, prior_filing): the latest revision of the period before."""
    p = F.upper("fiscal_period")
    prior = F.when(p == "Q2", "Q1").when(p == "Q3", "Q2").when(p.isin("FY", "ANNUAL"), "Q3")
    mine = filings.select("filing_id", "issuer_code", "fiscal_year", prior.alias("prior_period"))
    latest = filings.groupBy("issuer_code", "fiscal_year", F.col("fiscal_period").alias("prior_period")).agg(F.max_by("filing_id", F.struct("revision_number", "filing_id")).alias("prior_filing"))
    return mine.join(latest, ["issuer_code", "fiscal_year", "prior_period"], "left").select("filing_id", "prior_period", "prior_filing")


def wide_rows(filings: DataFrame, facts: DataFrame, dictionary: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One row per filing with everything the rules read. The facts are grouped by filing once; a second narrow pass gives what the cross-period rules join."""
    valued = F.collect_list(F.struct("normalized_fact_id", "canonical_concept", "value"))
    others = filings.select("filing_id").join(facts.where(F.col("value").isNotNull()).groupBy("filing_id").agg(valued.alias("valued")), "filing_id", "left")
    rows = filings.drop("owned", "valued").join(filing_facts(facts, dictionary), "filing_id", "left")
    return wide_of(rows, F.col("owned"), others, lambda row: F.col(row)["valued"], issues)


def wide_of(filings: DataFrame, owned: Column, others: DataFrame, valued: Callable[[str], Column], issues: DataFrame | None = None, beside: DataFrame | None = None, after: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
    """wide_rows of facts that are told from a narrow row: ``owned``, over the columns of ``filings``, is as of filing_facts and null without facts.

    ``others`` (filing_id, ..) has the row of each filing; from a column of that row, by its name, ``valued`` gives
    an array of ids, concepts and values. ``beside``, of one row, has what ``owned`` reads besides. ``after`` are tables
    by filing_id and kinds of join, whose columns come to the rows that the rules judge. Rows are sorted and joined as narrow as they come; arrays of facts are made
    after the last join, and no sort has to hold them. A filing without a period before
    gets a key of its own for that, so that no task sees all of them. Columns of ``filings`` stay.
    """
    head = filings.withColumn("superseded", F.nullif(F.trim("supersedes_filing_id"), F.lit("")))
    other = lambda key, name: others.select(F.col("filing_id").alias(key), F.struct(*others.columns).alias(name))
    old = head.where(F.col("superseded").isNotNull()).select("filing_id", "superseded").join(other("superseded", "old_row"), "superseded").drop("superseded")
    near = adjacent(filings).withColumn("before", F.coalesce("prior_filing", F.concat(F.lit("\x00"), "filing_id"))).join(other("before", "near_row"), "before", "left").drop("before")
    out = head.join(old, "filing_id", "left").join(near, "filing_id", "left")
    if issues is not None:
        zero = issues.where(F.lower("reason").contains("zero")).select("filing_id", F.lit(True).alias("zero_issue")).distinct()
        out = out.join(zero, "filing_id", "left")
    else:
        out = out.withColumn("zero_issue", F.lit(False))
    for df, how in after:
        out = out.join(df, "filing_id", how)
    if beside is not None:
        out = out.crossJoin(beside)
    # arrays of facts are columns read twice: what is written into a lambda's argument would not be compiled
    made = {"old_facts": F.when(F.col("old_row").isNotNull(), valued("old_row")), "near_facts": F.when(F.col("near_row").isNotNull(), valued("near_row"))}
    out = out.withColumns({"owned": owned, **made, "superseded_known": F.col("old_row").isNotNull()}).drop("old_row", "near_row", *(beside.columns if beside is not None else ()))
    last = F.when(F.col("old_facts").isNotNull(), _last(_by_concept("old_facts")))
    reported = F.transform("near_facts", lambda x: F.when(x["value"].isNotNull(), x["canonical_concept"]))
    theirs = F.when(F.col("near_facts").isNotNull(), F.array_intersect(F.array(*map(F.lit, COMPARED)), reported))
    out = out.withColumns({"last": last, "theirs": theirs}).withColumn("old", F.map_from_arrays("last.c", "last.v")).drop("last", "old_facts", "near_facts")

    ids = lambda facts: F.transform(facts, lambda x: x["normalized_fact_id"])
    named = lambda cond: ids(F.filter("owned", cond))
    found = lambda field: F.sort_array(F.array_except(f"owned.{field}", F.array(F.lit(""), F.lit(None).cast("string"))))
    empty = lambda c, kind="array<string>": F.coalesce(c, F.array().cast(kind))
    by = F.sort_array(F.transform("owned", lambda x: F.struct(x["same"].alias("s"), x["value"].alias("v"))))
    shared = F.size(F.array_distinct("owned.same")) < F.size("owned")
    out = out.withColumns({"apart": empty(F.when(shared, F.array_distinct(F.array_compact(let(by, _differing))))), "valued_of": F.transform("owned", lambda x: F.when(x["value"].isNotNull(), x["canonical_concept"]))})
    restated = lambda: F.transform(F.filter(_last(_by_concept("owned")), lambda x: F.try_element_at("old", x["c"]) != x["v"]), lambda x: x["c"])
    among = lambda concepts: let(concepts, lambda cs: named(lambda x: F.array_contains(cs, x["canonical_concept"])))
    # of several groups that disagree the one of the first fact is named
    first_apart = lambda apart: F.get(F.filter("owned", lambda x: F.array_contains(apart, x["same"])), F.lit(0))["same"]
    at = lambda field, array, x: F.get(f"owned.{field}", (F.array_position(array, F.lit(x)) - 1).cast("int"))
    value = lambda c: at("value", "valued_of", c)
    first = lambda flag: at("normalized_fact_id", f"owned.{flag}", True)
    return out.withColumns({
        **{c: value(c) for c in CONCEPTS},
        **{flag: first(flag) for flag in ("bad_dates", "bad_period_type", "bad_dimension", "bad_unit", "bad_scope", "bad_nil")},
        "currencies": empty(found("currency")), "scopes": empty(found("scope")),
        "conflicts": F.size("apart"), "conflict_ids": empty(F.when(F.size("apart") > 0, let(let(F.col("apart"), first_apart), lambda s: named(lambda x: x["same"] == s)))),
        "changed_ids": empty(F.when(F.col("old").isNotNull(), among(restated()))),
        "overlap_ids": empty(F.when(F.col("theirs").isNotNull(), named(lambda x: x["value"].isNotNull() & F.array_contains("theirs", x["canonical_concept"])))),
        "zero_issue": F.coalesce("zero_issue", F.lit(False)),
    }).drop("apart", "valued_of", "old", "theirs")


def outcomes(wide: DataFrame, rules: dict[str, Rule] | None = None, mode: str = "service", severities: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(filing_id, *keep, outcomes): all results of a filing in one array, in rule order; a configured severity replaces any but INFO."""
    rules = rules or RULES
    named = F.create_map(*(F.lit(v) for pair in severities.items() for v in pair)) if severities else None

    def own(code: str, said: Column) -> Column:
        return said if named is None else F.when(said == "INFO", said).otherwise(F.coalesce(F.try_element_at(named, F.lit(code)), said))

    # a column for each rule, which is compiled; in an array that a lambda reads it would be interpreted
    judged = wide.withColumns({f"o_{code}": rule.evaluate(mode) for code, rule in rules.items()})
    o = {code: F.col(f"`o_{code}`") for code in rules}
    each = [F.struct(F.lit(code).alias("rule_code"), F.lit(rule.version).cast("bigint").alias("rule_version"), o[code].alias("o"), own(code, o[code]["severity"]).alias("severity")) for code, rule in rules.items()]
    if any(rule.applies is not always for rule in rules.values()):
        return judged.select("filing_id", *keep, F.array_compact(F.array(*[F.when(rule.applies(), x) for rule, x in zip(rules.values(), each)])).alias("outcomes"))
    return judged.select("filing_id", *keep, F.array(*each).alias("outcomes"))


def results(outcomes: DataFrame, *columns: str) -> DataFrame:
    """(filing_id, *columns, rule_code, rule_version, result, severity, message, expected, actual, evidence): a row for each result."""
    # explode_outer, as for explode Spark filters by the array first and would evaluate all rules again
    rows = outcomes.select("filing_id", *columns, F.explode_outer("outcomes").alias("r")).where(F.col("r").isNotNull())
    return rows.select("filing_id", *columns, "r.rule_code", "r.rule_version", "r.o.result", "r.severity", "r.o.message", "r.o.expected", "r.o.actual", "r.o.evidence")


def only(rows: DataFrame, column: str) -> DataFrame:
    """rows whose array is neither null nor empty. A filter by it would go below what makes the array, and make it twice."""
    kept = F.explode_outer(F.when(F.size(column) > 0, F.array(column))).alias(column)
    return rows.select(*[c for c in rows.columns if c != column], kept).where(F.col(column).isNotNull())


def evaluate(wide: DataFrame, rules: dict[str, Rule] | None = None, mode: str = "service", severities: dict[str, str] | None = None) -> DataFrame:
    """(filing_id, rule_code, rule_version, result, severity, message, expected, actual, evidence) of every rule and filing."""
    return results(outcomes(wide, rules, mode, severities))
