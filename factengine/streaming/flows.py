"""Incremental discovery, normalization, monitoring and state, over streams or batches of the same shape."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import current_mappings, normalize
from ..sources.sinks import append_new


def discovered(candidates: DataFrame, within: str = "7 days") -> DataFrame:
    """Candidates once per idempotency key within the watermark of ``discovered_at``; the sink's anti-join covers later replays."""
    return candidates.withWatermark("discovered_at", within).dropDuplicatesWithinWatermark(["idempotency_key"])


def into_table(stream: DataFrame, path: str, keys: list[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each micro-batch, prepared, appended without the rows stored already; a repeated batch adds nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_new(prepare(df), path, keys)).start()


def normalize_stream(facts: DataFrame, mappings: DataFrame, dictionary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """New raw facts normalized against the static mappings and stored once."""
    now = current_mappings(mappings)
    return into_table(facts, path, ["record_id"], checkpoint, lambda df: normalize(df, now, dictionary))


def failures(runs: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(stage, bucket, executions, failures) per time window; with ``late`` as an append stream that waits so long for stragglers."""
    rows = runs.withWatermark("created_at", late) if late else runs
    bad = F.sum(F.when(F.col("status") == "FAILED", 1).otherwise(0)).cast("bigint")
    out = rows.groupBy("stage", F.window("created_at", width)).agg(F.count("*").alias("executions"), bad.alias("failures"))
    return out.select("stage", F.col("window.start").alias("bucket"), "executions", "failures")


def current_state(runs: DataFrame) -> DataFrame:
    """(filing_id, stage, status) of each filing's newest execution; as a stream in complete mode."""
    newest = F.max_by(F.struct("stage", "status"), F.struct("created_at", "job_run_id"))
    return runs.groupBy("filing_id").agg(newest.alias("s")).select("filing_id", "s.stage", "s.status")


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
