"""Sessions, landing folders and result tables of the streams.

A stream reads a folder in which arrivals land, and writes the rows of a
micro-batch to that batch's own folder. A batch that is run again after a lost
driver overwrites its folder, so results hold every batch once, and a restart
without new files adds nothing.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import exists, shuffles_let_go

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Session settings that a stream takes over from the session that starts it.
TAKEN_OVER = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with state in RocksDB; the caller's settings stay as they are."""
    session = spark.newSession()
    for key in TAKEN_OVER:
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


def land(rows: DataFrame, path: str) -> None:
    """Rows as new files of a landing folder."""
    with shuffles_let_go(rows.sparkSession):
        rows.write.mode("append").parquet(path)


def batch_folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def run_available(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """What has landed so far goes through the stream; ``path`` holds its checkpoint and its results by batch.

    ``each`` turns a micro-batch and its number into the rows to be kept.
    """

    def store(rows: DataFrame, batch: int) -> None:
        kept = rows if each is None else each(rows, batch)
        with shuffles_let_go(kept.sparkSession):
            kept.write.mode("overwrite").parquet(batch_folder(f"{path}/rows", batch))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return query


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that a stream has kept, with ``batch``; none where no batch has run yet."""
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(f"{path}/rows")


def dropped_late(query: StreamingQuery) -> int:
    """Rows that the stream's operators have dropped as older than the watermark."""
    return sum(int(state["numRowsDroppedByWatermark"]) for progress in query.recentProgress for state in progress["stateOperators"])


def epoch_micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))
