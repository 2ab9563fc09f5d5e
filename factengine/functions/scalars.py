"""Scalar rules as pure Column -> Column functions; all run inside code generation, none needs Python on executors.

Absent, nil and zero stay apart: nothing here turns a null into a number.
"""

from pyspark.sql import Column, functions as F

DECIMAL = "decimal(36,18)"
TOLERANCE = 1000
STRICT_NUMBER = r"^[+-]?(\d+(\.\d+)?|\.\d+)$"
LEXICAL_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
ZERO = r"^[+-]?0(\.0+)?$"
PUBLISHED_NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?$"
CONTROL = r"[\x00-\x1F\x7F]"


def decimal_of(x: Column) -> Column:
    """decimal(36,18); null where the text is no number or has more than 18 integer digits."""
    return x.try_cast(DECIMAL)


def lenient_number(x: Column) -> Column:
    """Blank, none, null, nil and nan are null, as is what does not parse."""
    text = F.trim(x)
    return F.when(F.lower(text).isin("", "none", "null", "nil", "nan"), None).otherwise(decimal_of(text))


def is_strict_number(x: Column) -> Column:
    return F.coalesce(F.trim(x).rlike(STRICT_NUMBER), F.lit(False))


def is_lexical_decimal(x: Column) -> Column:
    return F.coalesce(F.trim(x).rlike(LEXICAL_NUMBER), F.lit(False))


def is_zero_text(x: Column) -> Column:
    return F.coalesce(F.trim(x).rlike(ZERO), F.lit(False))


def numeric_text(is_nil: Column, normalized: Column, raw: Column) -> Column:
    """The value to normalize: null for nil, blank or malformed; without a leading plus."""
    value = F.trim(F.coalesce(normalized, raw))
    return F.when(~is_nil & is_strict_number(value), F.regexp_replace(value, r"^\++", ""))


def invalid_number(is_nil: Column, normalized: Column, raw: Column) -> Column:
    value = F.trim(F.coalesce(normalized, raw))
    return ~is_nil & value.isNotNull() & (value != "") & ~is_strict_number(value)


def signed(value: Column, convention: Column) -> Column:
    """value (decimal) under a sign convention; null where that is unknown. Zero has no sign."""
    c = F.upper(F.trim(F.coalesce(convention, F.lit(""))))
    flipped = F.when(value == 0, value).otherwise(-value)
    return (
        F.when(c.isin("", "AS_REPORTED", "KEEP"), value)
        .when(c == "NEGATE", flipped)
        .when(c.isin("ABSOLUTE", "POSITIVE"), F.abs(value))
        .when(c == "NEGATIVE", F.when(value == 0, value).otherwise(-F.abs(value)))
    ).cast(DECIMAL)


def known_sign(convention: Column) -> Column:
    return F.upper(F.trim(F.coalesce(convention, F.lit("")))).isin("", "AS_REPORTED", "KEEP", "NEGATE", "ABSOLUTE", "POSITIVE", "NEGATIVE")


def availability(is_nil: Column, value: Column, normalized: Column | None = None) -> Column:
    known = F.lit(True) if normalized is None else normalized
    return F.when(is_nil, "NIL").when(~known, "UNKNOWN").when(value.isNull(), "MISSING").otherwise("AVAILABLE")


def scope_of(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    has = lambda *words: t.rlike("|".join(words))
    return F.when(has("group", "grup"), "CONSOLIDATED").when(has("single", "tunggal", "individual"), "PARENT").otherwise("UNKNOWN")


def currency_of(text: Column) -> Column:
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.rlike("USD|DOLLAR|AMERIKA"), "USD").when(t.rlike("IDR|RUPIAH"), "IDR")


def entry_class(namespace: Column) -> Column:
    n = F.lower(F.coalesce(namespace, F.lit("")))
    return F.when(n.contains("financesharia"), "financesharia").when(n.contains("infrastructure"), "infrastructure").otherwise("general")


def quarter_end(period: Column) -> Column:
    """-MM-DD expected at the end of a period named by its quarter."""
    ends = {"Q1": "-03-31", "Q2": "-06-30", "Q3": "-09-30", "Q4": "-12-31"}
    out = F.lit(None).cast("string")
    for q, end in ends.items():
        out = F.when(period.endswith(q), end).otherwise(out)
    return out


def is_strict_date(text: Column) -> Column:
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(day, "yyyy-MM-dd") == text), F.lit(False))


def utc_of_text(text: Column) -> Column:
    """A time with an offset or Z as UTC to the second, in utc_text's form; null for texts without an offset and for what is no time."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$")
    timed = F.regexp_replace(text, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    at = F.when(zoned, F.try_to_timestamp(F.regexp_replace(timed, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def utc_text(ts: Column) -> Column:
    """ISO-8601 in UTC; the session runs in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def is_identifier(x: Column, most: int = 128) -> Column:
    return F.coalesce((F.octet_length(x) <= most) & x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False))


def is_fiscal_period(x: Column) -> Column:
    return F.coalesce((F.octet_length(x) <= 20) & x.rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False))


def is_adapter(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[a-z0-9][a-z0-9._-]{0,63}$"), F.lit(False))


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


PRIVATE_HOST = r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)[0-9.]+$|^localhost(\.localdomain)?$|\.localhost$"


def url_problem(url: Column, allowed_hosts: list[str]) -> Column:
    """Why a source url is refused; null for a good one. ``*.name`` allows all subdomains of name."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*:(\d+)", 1)
    named = host.isin([h for h in allowed_hosts if not h.startswith("*.")])
    for h in allowed_hosts:
        if h.startswith("*."):
            named = named | host.endswith(h[1:])
    return (
        F.when(url.isNull() | ~scheme.isin("http", "https") | (host == ""), "invalid")
        .when(~port.isin("", "80", "443"), "port")
        .when(~named, "host")
        .when(host.rlike(PRIVATE_HOST), "private")
    )


def is_relative_path(path: Column) -> Column:
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    return F.coalesce((p != "") & ~p.startswith("/") & ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.rlike(CONTROL), F.lit(False))


def safe_filename(name: Column) -> Column:
    """Last path part with other characters as _; null where nothing usable is left."""
    base = F.regexp_extract(F.replace(F.trim(name), F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)
    clean = F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_")
    return F.when(~clean.isin("", ".", ".."), clean)


SOURCE_TYPES = ("XBRL_INSTANCE", "INLINE_XBRL", "XLSX", "PDF", "OTHER")
REPORT_TYPES = ("ANNUAL", "QUARTERLY", "INTERIM", "OTHER")


def one_of(x: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False))


def mapping_status(x: Column) -> Column:
    s = F.upper(F.trim(x))
    return F.when(s == "PROPOSED", "DRAFT").when(s == "CONFIRMED", "APPROVED").otherwise(s)


def trailing_version(x: Column) -> Column:
    digits = F.regexp_extract(x, r"(\d+)$", 1)
    return F.when(digits == "", 1).otherwise(digits.try_cast("bigint"))


def listed(x: Column) -> Column:
    """A ;-separated list without its blank entries."""
    return F.filter(F.transform(F.split(x, ";"), lambda v: F.trim(v)), lambda v: v != "")


def within_tolerance(a: Column, b: Column, tolerance: int = TOLERANCE) -> Column:
    return F.abs(a - b) <= F.lit(tolerance)


def is_published_number(x: Column) -> Column:
    return F.coalesce(x.rlike(PUBLISHED_NUMBER), F.lit(False))


def is_logical_reference(x: Column) -> Column:
    """No drive, root or url."""
    return ~x.rlike(r"^([A-Za-z]:[\\/]|[\\/]|https?://)")


def contains_text(term: str, *columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *columns)).contains(term.lower())


def period_filter(term: str) -> Column:
    return F.col("fiscal_year") == int(term) if term.isdigit() else F.col("fiscal_period") == term


SECRET = r"(?i)(Bearer\s+|(?:token|secret|password|api[_-]?key)\s*[=:]\s*)[^\s,;]+"
SENSITIVE_KEY = r"(?i)token|secret|password|credential|api[_-]?key|authorization"


def redact(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "$1[REDACTED]")


def redact_map(values: Column) -> Column:
    """A map<string,string> with sensitive keys blanked and secrets in the other values redacted."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit("[REDACTED]")).otherwise(redact(v)))


def fact_period(period_type: Column, start: Column, end: Column, instant: Column) -> tuple[Column, Column]:
    lasting = F.coalesce(period_type == "DURATION", F.lit(False))
    return F.when(lasting, start), F.when(lasting, end).otherwise(instant)
