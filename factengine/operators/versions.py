"""Content-hashed versions of data sets."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import _text, set_version
from .latest import at_latest_version


def _ordered(df: DataFrame, keys: list[str], order: list[str], entry) -> DataFrame:
    """keys + entries: strings in the order of ``order``, whatever partitions they come from."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, entry.alias("entry"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["entry"]).alias("entries"))


def dataset_versions(facts: DataFrame, version: str = "v1") -> DataFrame:
    """(filing_id, dataset_version) over a filing's facts in id order."""
    parts = ["normalized_fact_id", "raw_fact_id", "mapping_rule_id", "mapping_rule_version", "value", F.lit(version)]
    entries = _ordered(facts, ["filing_id"], ["normalized_fact_id"], F.concat_ws(":", *_text(parts)))
    return entries.select("filing_id", set_version("normalized_", F.col("entries")).alias("dataset_version"))


def fact_entry(f, version: str = "v1") -> Column:
    """What dataset_versions hashes of a fact, whose columns ``f`` has by name."""
    parts = ("raw_fact_id", "mapping_rule_id", "mapping_rule_version", "value")
    return F.concat_ws(":", *_text([f["normalized_fact_id"], *(f[p] for p in parts), F.lit(version)]))


def listed_version(facts: Column | str, version: str = "v1") -> Column:
    """dataset_versions of an array of a filing's facts."""
    entry = lambda f: fact_entry(f, version)
    pairs = F.sort_array(F.transform(facts, lambda f: F.struct(f["normalized_fact_id"].alias("id"), entry(f).alias("entry"))))
    return set_version("normalized_", F.transform(pairs, lambda p: p["entry"]))


def extraction_versions(raw: DataFrame, parser: str, config: str) -> DataFrame:
    entries = _ordered(raw, ["filing_id"], ["raw_fact_id"], F.concat_ws(":", *_text(["raw_fact_id", F.lit(parser), F.lit(config)])))
    return entries.select("filing_id", set_version("raw_", F.col("entries")).alias("extraction_version"))


def mapping_set_version(mappings: DataFrame) -> DataFrame:
    """One row: version of the approved mappings at their series' latest approved version (series_key is a column)."""
    top = at_latest_version(mappings.where(F.col("status") == "APPROVED"), ["series_key"], "rule_version")
    entries = F.array_sort(F.collect_list(F.concat_ws(":", *_text(["series_key", "mapping_rule_id", "rule_version"]))))
    return top.agg(set_version("set_", entries).alias("mapping_version"))


def rule_set_version(rules: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("rule_code", "rule_version")))
    entries = F.transform(pairs, lambda p: F.concat_ws(":", p["rule_code"], p["rule_version"].cast("string")))
    return rules.where(F.col("enabled") == 1).agg(set_version("rules_", entries).alias("rule_set_version"))
