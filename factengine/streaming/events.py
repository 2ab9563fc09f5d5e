"""Event-time streams: candidates once per key, failures by window, with rows older than the watermark dropped and counted."""

from pyspark.sql import DataFrame, functions as F

from ..functions import ids
from .flows import failures

CANDIDATES = "idempotency_key string, filing_id string, created_at timestamp"
FAILURES = "stage string, bucket timestamp, executions bigint, failures bigint"


def candidate_key(adapter: str, window: str):
    inputs = {"source_adapter": F.lit(adapter), "discovery_window": F.lit(window), "stable_candidate_identity": F.concat("filing_id", F.lit("@"), F.col("job_run_id").cast("string"))}
    return ids.idempotency_key("discovery", inputs)


def candidates_once(runs: DataFrame, delay: str, adapter: str = "web", window: str = "d") -> DataFrame:
    """CANDIDATES of a stream of executions: the first of each key within the delay; state holds the keys of the delay only.

    A replay within the delay meets its key in the state; an older one is behind
    the watermark and dropped as late, as is a new candidate of so old a time.
    """
    timed = runs.withWatermark("created_at", delay).withColumn("idempotency_key", candidate_key(adapter, window))
    return timed.dropDuplicatesWithinWatermark(["idempotency_key"]).select("idempotency_key", "filing_id", "created_at")


def failures_by_window(runs: DataFrame, delay: str, width: str = "1 hour") -> DataFrame:
    """FAILURES by stage and window as an append stream: a window is emitted once, when the watermark has passed its end; later rows of it are dropped."""
    return failures(runs.where("stage is not null or filing_id = ''"), width, late=delay)
