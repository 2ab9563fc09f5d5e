"""Requests for new mapping versions, decided one after another.

A request is accepted if it expects the version that its series has when its
turn comes; each accepted one raises the version by one, so later requests of a
batch build on earlier ones. The fold of a series is cut in blocks of its order.
A block is summed up as the version in which it ends for each one in which it may
begin; these sums are composed series by series, and then every block is decided
from its own beginning. So a series that has most of the requests is spread over
many tasks, and no task holds more than a block of it.
"""

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import ids
from ..sources.sinks import scratch
from .latest import latest

#: Requests of a block, about; a range partition of the order.
BLOCK = 100_000
CODES = ("MAPPING_SERIES_MISMATCH", "MAPPING_VERSION_STALE", "EVIDENCE_NOT_FOUND", "EVIDENCE_NOT_OWNED")


def evidence_codes(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request_id, evidence_code) of requests with unknown or foreign evidence; evidence (evidence_id, source_concept): a record without a concept belongs to all."""
    c = F.col
    named = requests.select("request_id", c("source_concept").alias("concept"), F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    found = named.join(evidence.select("evidence_id", c("source_concept").alias("owner"), F.lit(True).alias("known")), "evidence_id", "left")
    bad = F.when(c("known").isNull(), 1).when(c("owner").isNotNull() & ~c("owner").eqNullSafe(c("concept")), 2)
    worst = found.groupBy("request_id").agg(F.min(bad).alias("bad"))  # not found comes first
    return worst.where(c("bad").isNotNull()).select("request_id", F.when(c("bad") == 1, CODES[2]).otherwise(CODES[3]).alias("evidence_code"))


def _ends(group: pd.DataFrame) -> pd.DataFrame:
    """Where a block ends for each version that it may begin in and changes: from its last request to its first."""
    ends: dict[int, int] = {}
    for expected in reversed(group.loc[group["good"], :].sort_values(["place", "request_id"])["expected_version"].tolist()):
        ends[expected] = ends.get(expected + 1, expected + 1)
    starts = sorted(ends)
    return pd.DataFrame({"series_key": [group["series_key"].iloc[0]], "block": [group["block"].iloc[0]], "starts": [starts], "ends": [[ends[s] for s in starts]]})


def _decided(group: pd.DataFrame) -> pd.DataFrame:
    """A block's requests with the version that each of them met, and whether it was accepted."""
    group = group.sort_values(["place", "request_id"])
    version, met, accepted = int(group["start"].iloc[0]), [], []
    for expected, good in zip(group["expected_version"], group["good"]):
        yes = good and expected == version
        met.append(version)
        accepted.append(yes)
        version += yes
    return pd.DataFrame({"request_id": group["request_id"], "met": met, "accepted": accepted})


def versions_in_order(requests: DataFrame, mappings: DataFrame, evidence: DataFrame, block: int = BLOCK) -> DataFrame:
    """requests with code (null: accepted), rule_version, mapping_rule_id of the new version and supersedes.

    requests: request_id, place (their order; equal places by id), series_key, source_namespace, source_concept,
    entry_point, expected_version (null for a series without a version), evidence_ids. A series without
    mappings starts without a version, which counts as version 0.
    """
    c = F.col
    top = latest(mappings, ["series_key"], F.desc("rule_version"), F.desc("mapping_rule_id")).select("series_key", c("rule_version").alias("top"), c("mapping_rule_id").alias("top_id"))
    derived = ids.series_key(c("source_namespace"), c("source_concept"), c("entry_point"))
    r = requests.withColumn("mismatch", derived != c("series_key")).join(evidence_codes(requests, evidence), "request_id", "left")
    r = r.withColumns({"expected_version": F.coalesce("expected_version", F.lit(0)).cast("bigint"), "good": ~c("mismatch") & c("evidence_code").isNull()})
    parts = r.count() // block + 1
    path = scratch(requests.sparkSession, "ordered_requests")
    r.repartitionByRange(parts, "series_key", "place", "request_id").withColumn("block", F.spark_partition_id()).write.parquet(path)
    r = requests.sparkSession.read.parquet(path)

    fold = r.select("series_key", "block", "place", "request_id", "expected_version", "good")
    ends = fold.groupBy("series_key", "block").applyInPandas(_ends, "series_key string, block int, starts array<bigint>, ends array<bigint>")
    blocks = ends.groupBy("series_key").agg(F.array_sort(F.collect_list(F.struct("block", "starts", "ends"))).alias("blocks")).join(top, "series_key", "left")
    begin = F.struct(F.coalesce("top", F.lit(0)).cast("bigint").alias("v"), F.array().cast("array<struct<block:int,start:bigint>>").alias("out"))

    def step(acc, b):
        end = F.coalesce(F.try_element_at(F.map_from_arrays(b["starts"], b["ends"]), acc["v"]), acc["v"])
        return F.struct(end.alias("v"), F.array_append(acc["out"], F.struct(b["block"].alias("block"), acc["v"].alias("start"))).alias("out"))

    starts = blocks.select("series_key", F.explode(F.aggregate("blocks", begin, step)["out"]).alias("b")).select("series_key", "b.block", "b.start")
    decided = fold.join(starts, ["series_key", "block"]).groupBy("series_key", "block").applyInPandas(_decided, "request_id string, met bigint, accepted boolean")

    code = F.when(c("mismatch"), CODES[0]).when(c("expected_version") != c("met"), CODES[1]).otherwise(c("evidence_code"))
    out = r.join(decided, "request_id").withColumns({"code": code, "rule_version": F.when(c("accepted"), c("met") + 1), "mapping_rule_id": F.when(c("accepted"), F.concat(F.lit("MAP-"), "request_id"))})
    made = out.where("accepted").select("series_key", c("rule_version").alias("met"), c("mapping_rule_id").alias("before"))
    out = out.join(made, ["series_key", "met"], "left").join(top.select("series_key", "top_id"), "series_key", "left")
    supersedes = F.when(c("accepted"), F.coalesce("before", "top_id"))
    return out.withColumn("supersedes", supersedes).drop("mismatch", "good", "block", "met", "accepted", "before", "top_id", "evidence_code")


def version_audit(decided: DataFrame, actor: str = "system") -> DataFrame:
    """One audit row for each accepted request: what its series had before and has now, as JSON."""
    new = F.to_json(F.struct("mapping_rule_id", "rule_version", "source_concept", "supersedes"), {"ignoreNullFields": "false"})
    old = F.when(F.col("supersedes").isNotNull(), F.to_json(F.struct(F.col("supersedes").alias("mapping_rule_id"), (F.col("rule_version") - 1).alias("rule_version"))))
    accepted = decided.where(F.col("code").isNull())
    return accepted.select(F.lit(actor).alias("actor_id"), F.lit("concept_mapping.version_created").alias("action"), F.col("mapping_rule_id").alias("entity_id"), old.alias("old_value"), new.alias("new_value"))
