"""The stage machine of filings on a stream: illegal moves and stuck stages as they happen, current stages in state.

State is keyed by filing: the newest execution whose turn has come, and those
that still wait for the watermark, so that executions which arrive out of order
within the delay are judged in the order of their times. A timer of event time
stands at the first waiting execution; another at the time from which a running
stage counts as stuck. Waiting rows of a filing are as many as it has within
the delay.

Executions older than the watermark are dropped and counted by Spark. A filing's
last execution is judged once later rows, of any filing, have moved the watermark
past it.
"""

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ops import NEXT
from .runtime import epoch_micros

ALERTS = "filing_id string, kind string, job_run_id bigint, stage string, next_stage string, at bigint"
ILLEGAL, STUCK = "ILLEGAL_TRANSITION", "STUCK"


class StageMachine(StatefulProcessor):
    def __init__(self, stuck_after_ms: int):
        self.limit = stuck_after_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("current", "at bigint, job_run_id bigint, stage string, status string, reported boolean")
        self.waiting = handle.getListState("waiting", "at bigint, job_run_id bigint, stage string, status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(r.at), int(r.job_run_id), r.stage, r.status) for part in rows for r in part.itertuples(index=False)]
        self.waiting.appendList(new)
        self._wake(min(at for at, *_ in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] <= reached]
        rest = waiting[len(due) :]
        now = tuple(self.now.get()) if self.now.exists() else None
        found = []
        for at, job, stage, status in due:
            if now is not None:
                found += self._stuck(key[0], now, at)
                if NEXT.get(now[2]) != stage:
                    found.append((key[0], ILLEGAL, now[1], now[2], stage, now[0]))
            now = (at, job, stage, status, False)
        if now is not None:
            if late := self._stuck(key[0], now, reached):
                found += late
                now = (*now[:4], True)
            elif now[3] == "RUNNING" and not now[4]:
                self._wake(now[0] + self.limit)
            self.now.update(now)
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        if rest:
            self._wake(rest[0][0])
        yield pd.DataFrame(found, columns=["filing_id", "kind", "job_run_id", "stage", "next_stage", "at"])

    def close(self) -> None:
        pass

    def _stuck(self, filing: str, now: tuple, until: int) -> list[tuple]:
        """An alert if the stage has been running up to ``until`` for the limit, and has not been reported."""
        at, job, stage, status, reported = now
        return [(filing, STUCK, job, stage, None, at)] if status == "RUNNING" and not reported and until >= at + self.limit else []

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))  # timers have milliseconds; never before the event


def stage_alerts(runs: DataFrame, delay: str = "1 hour", stuck_after_ms: int = 86_400_000) -> DataFrame:
    """ALERTS of a stream of executions (filing_id, job_run_id, stage, status, created_at), without those that lack an id: moves that are not legal, by the execution left, and stages running for too long."""
    known = F.col("filing_id").isNotNull() & F.col("job_run_id").isNotNull()
    timed = runs.where(known).withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    rows = timed.withColumn("at", epoch_micros("created_at"))
    return rows.groupBy("filing_id").transformWithStateInPandas(StageMachine(stuck_after_ms), ALERTS, "Append", "EventTime")


def stage_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(filing_id, stage, status, job_run_id, at) of each filing, read from the stream's state."""
    state = spark.read.format("statestore").option("stateVarName", "current").load(checkpoint)
    return state.select("key.filing_id", "value.stage", "value.status", "value.job_run_id", "value.at")


def closing_row(rows: DataFrame, time: str, delay: str, blank: dict[str, Column]) -> DataFrame:
    """One row, later than all others by the delay and a second, so that the watermark passes the last of them."""
    end = F.max(F.col(time).cast("timestamp")) + F.expr(f"interval {delay}") + F.expr("interval 1 second")
    last = rows.agg(end.alias("__end"))
    return last.select(*[F.col("__end").cast(rows.schema[c].dataType).alias(c) if c == time else blank.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
