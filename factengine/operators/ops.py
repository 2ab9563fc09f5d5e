"""Pipeline operations: activity, stage summaries, history, transitions, prerequisites."""

from pyspark.sql import DataFrame, functions as F

from .latest import latest

STAGES = ("DOWNLOAD", "PARSE", "NORMALIZE", "VALIDATE", "PUBLISH")
ALIASES = {"DOWNLOADING": "DOWNLOAD", "PARSING": "PARSE", "NORMALIZING": "NORMALIZE", "VALIDATING": "VALIDATE", "PUBLISHING": "PUBLISH"}
NEXT = {"DISCOVERED": "DOWNLOADING", "DOWNLOADED": "PARSING", "PARSED": "NORMALIZING", "NORMALIZED": "VALIDATING", "VALIDATED": "PUBLISHING"}


def canonical_stage(stage):
    out = stage
    for alias, name in ALIASES.items():
        out = F.when(stage == alias, name).otherwise(out)
    return out


def last_activity(runs: DataFrame) -> DataFrame:
    return runs.groupBy("filing_id").agg(F.max(F.coalesce("finished_at", "created_at")).alias("last_processed_at"))


def pipeline_summary(filings: DataFrame, runs: DataFrame) -> DataFrame:
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    status = F.coalesce("quality_status", F.lit("PENDING"))
    part = filings.agg(F.count("*").alias("total"), n(status == "VERIFIED").alias("verified"), n(status == "REVIEW_REQUIRED").alias("review"), n(status == "PENDING").alias("pending"))
    jobs = runs.agg(n(F.col("status") == "FAILED").alias("failed_executions"), n(F.col("status") == "RUNNING").alias("active"))
    return part.join(jobs, F.lit(True))  # one row each


def latest_runs(runs: DataFrame) -> DataFrame:
    """(filing_id, run_id) of each filing's latest run."""
    return runs.groupBy("filing_id").agg(F.max("run_id").alias("run_id"))


def stage_summaries(runs: DataFrame) -> DataFrame:
    """A row per latest run and stage, NOT_STARTED where nothing ran; the latest attempt counts."""
    now = latest_runs(runs)
    jobs = runs.join(now, ["filing_id", "run_id"], "left_semi").withColumn("stage", canonical_stage(F.col("stage")))
    last = latest(jobs, ["filing_id", "run_id", "stage"], F.desc("job_run_id"))
    every = now.select("filing_id", "run_id", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    return every.join(last.select("filing_id", "run_id", "stage", "status", "attempt"), ["filing_id", "run_id", "stage"], "left").select("filing_id", "run_id", "stage", F.coalesce("status", F.lit("NOT_STARTED")).alias("status"), "attempt")


def latest_errors(runs: DataFrame) -> DataFrame:
    """The newest failed attempt with a message, per latest run."""
    jobs = runs.join(latest_runs(runs), ["filing_id", "run_id"], "left_semi").where((F.col("status") == "FAILED") & F.col("error_message").isNotNull())
    return latest(jobs, ["filing_id"], F.desc("job_run_id")).select("filing_id", canonical_stage(F.col("stage")).alias("stage"), "error_message")


def retryable(runs: DataFrame) -> DataFrame:
    """(filing_id, job_run_id): the first stage in order whose latest attempt failed for a passing reason and can be repeated."""
    jobs = runs.join(latest_runs(runs), ["filing_id", "run_id"], "left_semi").withColumn("stage", canonical_stage(F.col("stage"))).where(F.col("stage").isin(*STAGES))
    last = latest(jobs, ["filing_id", "stage"], F.desc("job_run_id"))
    good = last.where((F.col("status") == "FAILED") & (F.col("failure_classification") == "TRANSIENT") & F.col("logical_input_hash").isNotNull())
    return good.groupBy("filing_id").agg(F.min_by("job_run_id", F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))).alias("job_run_id"))


def history(runs: DataFrame, attempts: DataFrame, audits: DataFrame) -> DataFrame:
    """Runs, attempts and audit events as one list of entries."""
    kind = lambda df, name: df.withColumn("type", F.lit(name))
    return kind(runs, "pipelineRun").unionByName(kind(attempts, "jobAttempt"), allowMissingColumns=True).unionByName(kind(audits, "auditEvent"), allowMissingColumns=True)


def transition_violations(moves: DataFrame) -> DataFrame:
    """moves (filing_id, stage, next_stage, quality_status) that are not legal; publishing needs VERIFIED."""
    legal = F.lit(None).cast("string")
    for stage, after in NEXT.items():
        legal = F.when(F.col("stage") == stage, after).otherwise(legal)
    gate = (F.col("next_stage") == "PUBLISHING") & (F.col("quality_status") != "VERIFIED")
    problem = F.when(~legal.eqNullSafe(F.col("next_stage")), "ILLEGAL_TRANSITION").when(gate, "NOT_VERIFIED")
    return moves.withColumn("problem", problem).where(F.col("problem").isNotNull())


def prerequisites(requests: DataFrame, filings: DataFrame, artifacts: DataFrame, raw: DataFrame, normalized: DataFrame, results: DataFrame) -> DataFrame:
    """requests (filing_id, stage) with what is missing before that stage can run again; null where nothing is."""
    has = lambda df, name: df.select("filing_id").distinct().withColumn(name, F.lit(True))
    r = requests.join(filings.select("filing_id", "source_url", "storage_path", "quality_status"), "filing_id", "left")
    for df, name in ((artifacts, "artifact"), (raw, "raw"), (normalized, "normalized"), (results, "validated")):
        r = r.join(has(df, name), "filing_id", "left")
    c = F.col
    no = lambda name: c(name).isNull()
    missing = (
        F.when((c("stage") == "DOWNLOAD") & (F.trim(F.coalesce("source_url", F.lit(""))) == ""), "SOURCE_LOCATOR").when((c("stage") == "PARSE") & (c("storage_path").isNull() | no("artifact")), "ARTIFACT")
        .when((c("stage") == "NORMALIZE") & no("raw"), "RAW_FACTS").when((c("stage") == "VALIDATE") & no("normalized"), "NORMALIZED_FACTS").when((c("stage") == "PUBLISH") & ((c("quality_status") != "VERIFIED") | no("validated")), "VERIFIED_RESULT")
    )
    return r.select("filing_id", "stage", missing.alias("missing"))


def listing(filings: DataFrame, runs: DataFrame) -> DataFrame:
    """Filings with their last activity; sorts put filings without one last."""
    return filings.join(last_activity(runs), "filing_id", "left")


ACTIVE = tuple(ALIASES)


def release_summary(filings: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of counters over filings (processing_stage, quality_status): all, in an active stage, by status; and failed executions."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    status = F.coalesce("quality_status", F.lit("PENDING"))
    failed = runs.where(F.col("status") == "FAILED").agg(F.count("*")).scalar()
    out = filings.agg(
        F.count("*").alias("total"), n(F.col("processing_stage").isin(*ACTIVE)).alias("active"), n(status == "FAILED").alias("failed"), n(status == "VERIFIED").alias("verified"),
        n(status == "REVIEW_REQUIRED").alias("review"), n(status == "PENDING").alias("pending"),
    )
    return out.withColumn("failed_executions", failed)


def detail(filings: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """filings with run_id, attempts (newest first), error (the newest message) and artifacts of each; null and empty where there is none."""
    now = runs.join(latest_runs(runs), ["filing_id", "run_id"], "left_semi")
    attempt = F.struct("job_run_id", canonical_stage(F.col("stage")).alias("stage"), "status", "attempt")
    failed = (F.col("status") == "FAILED") & F.col("error_message").isNotNull()
    of_run = now.groupBy("filing_id").agg(F.max("run_id").alias("run_id"), F.sort_array(F.collect_list(attempt), asc=False).alias("attempts"), F.max_by("error_message", F.when(failed, F.col("job_run_id"))).alias("error"))
    files = artifacts.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("source_hash", "artifact_type", "size_bytes"))).alias("artifacts"))
    return filings.join(of_run, "filing_id", "left").join(files, "filing_id", "left")
