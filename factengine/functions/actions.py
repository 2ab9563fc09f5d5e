"""What a user may do with a filing, a mapping series or a fact: struct(allowed, reason_code) Columns."""

from pyspark.sql import Column, functions as F


def capability(allowed: Column, reason_code: str) -> Column:
    allowed = F.coalesce(allowed, F.lit(False))
    return F.struct(allowed.alias("allowed"), F.when(~allowed, reason_code).alias("reason_code"))


def of_filing(storage_path: Column, retry_run: Column) -> dict[str, Column]:
    return {"view_artifact": capability(storage_path.isNotNull(), "ARTIFACT_NOT_AVAILABLE"), "retry": capability(retry_run.isNotNull(), "NOT_RETRYABLE")}


def of_series(mapping_rule_id: Column, status: Column) -> dict[str, Column]:
    """A series can always be edited; a preview needs a mapping, and a reprocess an approved one."""
    return {"edit": capability(F.lit(True), ""), "preview_impact": capability(mapping_rule_id.isNotNull(), "UNMAPPED_SERIES"), "reprocess": capability(status == "APPROVED", "MAPPING_NOT_APPROVED")}


def of_fact(storage_path: Column, mapping_rule_id: Column) -> dict[str, Column]:
    return {"open_evidence": capability(storage_path.isNotNull(), "EVIDENCE_NOT_AVAILABLE"), "open_mapping": capability(mapping_rule_id.isNotNull(), "MAPPING_NOT_AVAILABLE")}
