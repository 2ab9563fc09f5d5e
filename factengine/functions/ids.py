"""Content hashes used as keys. A null part counts as an empty one."""

from pyspark.sql import Column, functions as F


def _text(parts) -> list[Column]:
    return [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]


def digest(separator: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(separator, *_text(parts)), 256)


def extraction_id(prefix: str, *parts: Column | str) -> Column:
    """ctx_, unit_, dim_ and fact_ ids of the extraction."""
    return F.concat(F.lit(prefix), F.substring(digest("\x1f", *parts), 1, 24))


def stored_id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest("|", *parts), 1, 24))


def normalized_fact_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("nf_"), F.substring(digest("|", *parts), 1, 48))


def issue_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("normalization_issue_"), F.substring(digest("|", *parts), 1, 40))


def result_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("vr_"), F.substring(digest("|", *parts), 1, 48))


def snapshot_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("PUB-"), F.substring(digest("|", *parts), 1, 60))


def artifact_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("ART-"), F.substring(digest("|", *parts), 1, 64))


def series_key(namespace: Column, concept: Column, entry_point: Column) -> Column:
    """Without a namespace the key has two parts."""
    blank = F.trim(F.coalesce(namespace, F.lit(""))) == ""
    two = digest("|", F.trim(concept), F.trim(entry_point))
    return F.when(blank, two).otherwise(digest("|", F.trim(namespace), F.trim(concept), F.trim(entry_point)))


#: Inputs of each stage's idempotency key, in order (fixed by the key's format).
STAGE_INPUTS = {
    "discovery": ("source_adapter", "discovery_window", "stable_candidate_identity"),
    "download": ("filing_id", "source_locator", "revision_identifier"),
    "parse": ("filing_id", "source_hash", "parser_version", "parser_config_version"),
    "normalize": ("filing_id", "raw_extraction_version", "mapping_version", "normalization_version"),
    "validate": ("filing_id", "normalized_dataset_version", "validation_rule_set_version"),
    "publish": ("filing_id", "validation_run_id", "publish_contract_version"),
}


def idempotency_key(stage: str, inputs: dict[str, Column]) -> Column:
    """Hash of ``stage|name=value|...``; null where a required input is null or empty."""
    names = STAGE_INPUTS[stage]
    parts, complete = [F.lit(stage)], F.lit(True)
    for n in names:
        value = inputs[n].cast("string")
        complete = complete & F.coalesce(value != "", F.lit(False))
        for mark, code in (("%", "%25"), ("|", "%7C"), ("=", "%3D")):
            value = F.replace(value, F.lit(mark), F.lit(code))
        parts.append(F.concat(F.lit(f"{n}="), value))
    return F.when(complete, F.sha2(F.concat_ws("|", *parts), 256))


def source_element_id(candidates: list[Column], fingerprint: Column) -> Column:
    """First id that is not empty, else one derived from the fact's fingerprint."""
    given = [F.when(c != "", c) for c in candidates]
    return F.coalesce(*given, F.concat(F.lit("derived-"), F.substring(F.sha2(fingerprint, 256), 1, 32)))


def review_version(version: Column, rule: Column, rule_version: Column) -> Column:
    return F.concat_ws("|", *_text((version, rule, rule_version)))


def set_version(prefix: str, entries: Column) -> Column:
    """``prefix`` + 32 hex of the entries joined by |, ``empty`` for none; entries are an ordered array of strings."""
    return F.when(F.size(entries) > 0, F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(entries, "|"), 256), 1, 32))).otherwise("empty")
