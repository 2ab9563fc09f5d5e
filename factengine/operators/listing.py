"""Lists of stored snapshots and of mapping series: filters by path, row shape, pages of a whole order."""

from pyspark.sql import Column, DataFrame, functions as F

from .latest import numbered

#: Fields of a listed snapshot: path in its payload and type.
SHAPE = {"issuer_code": ("$.filing.issuer_code", "string"), "fiscal_year": ("$.filing.fiscal_year", "bigint"), "fiscal_period": ("$.filing.fiscal_period", "string"), "revision_number": ("$.filing.revision_number", "bigint")}


def field(path: str, kind: str) -> Column:
    """A value of the column ``payload`` (VARIANT); null where the payload lacks it or has another type."""
    return F.try_variant_get("payload", path, kind)


def stored_listing(snapshots: DataFrame, filters: dict[str, tuple[str, object]] | None = None, published_after: Column | None = None, size: int = 25) -> DataFrame:
    """(snapshot_id, filing_id, published_at, *SHAPE, place, page) of the verified snapshots (snapshot_id, filing_id, published_at, payload).

    Of a filing's snapshots the newest counts; each issuer's list is newest first, and its pages have ``size`` rows, so
    page n + 1 begins after the last (published_at, snapshot_id) of page n. ``filters`` maps a path to a type and value.
    """
    c = F.col
    rows = snapshots.where(field("$.quality.status", "string") == "VERIFIED")
    for path, (kind, value) in (filters or {}).items():
        rows = rows.where(field(path, kind) == F.lit(value))
    if published_after is not None:
        rows = rows.where(c("published_at") > published_after)
    shaped = rows.select("snapshot_id", "filing_id", "published_at", *[field(*where).alias(name) for name, where in SHAPE.items()])
    newest = F.max_by(F.struct(*shaped.columns), F.struct("published_at", "snapshot_id"))
    one = shaped.groupBy("filing_id").agg(newest.alias("s")).select("s.*")
    every = numbered(one, [F.asc("issuer_code"), F.desc("published_at"), F.desc("snapshot_id")], "_n")
    first = every.groupBy("issuer_code").agg(F.min("_n").alias("_first"))
    placed = every.join(first, "issuer_code").withColumn("place", c("_n") - c("_first") + 1)
    return placed.withColumn("page", F.floor((c("place") - 1) / size) + 1).select(*shaped.columns, "place", "page")


def inventory_list(inventory: DataFrame, search: str = "", status: str | None = None, entry_point: str | None = None) -> DataFrame:
    """Rows of an inventory (source_concept, entry_point, display_status, canonical_concept, series_key, ..) that hold the search text in any of its texts, with their place in the list."""
    text = F.lower(F.concat_ws(" ", "source_concept", F.coalesce("entry_point", F.lit("")), "display_status", F.coalesce("canonical_concept", F.lit(""))))
    rows = inventory.where(text.contains(search.strip().lower()))
    if status is not None:
        rows = rows.where(F.col("display_status") == status)
    if entry_point is not None:
        rows = rows.where(F.col("entry_point") == entry_point)
    return numbered(rows, [F.asc("source_concept"), F.asc_nulls_first("entry_point"), F.asc("series_key")], "place")
