"""Shared helpers: Arrow row mapping, frozen tables, ASCII lower-casing.

Row contract of every operator here: extra input columns are ignored unless an
operator lists them under ``keep``, so clashing names cannot reach the output.
"""

import contextlib
import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES, so that long texts do not add up in a worker. Settings of the session; smaller ones stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(re.sub(r"[bB]$", "", spark.conf.get(key))) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; without one (tests), a folder of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_frozen"


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here and row order within files is fixed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, make, schema: str, kept: int = 0, reads: list[str] | None = None) -> DataFrame:
    """mapInArrow with one Python call per row.

    ``make()`` runs once per task and returns ``f(row: tuple) -> tuple | None``;
    a None drops the row. Output batches follow the input batches. The first
    ``kept`` columns pass by untouched: f returns what follows them, and drops no
    row then. f gets the columns after them, or those named in ``reads``, which
    may be kept ones; strings come as UTF-8 bytes then, null as empty.
    """
    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    names = df.columns[kept:] if reads is None else reads

    def values(column):
        if reads is not None and pa.types.is_string(column.type):
            column = column.cast(pa.binary()).fill_null(b"")
        return column.to_pylist()

    def run(batches):
        f = make()
        for batch in batches:
            found = [r for r in map(f, zip(*(values(batch.column(c)) for c in names))) if r is not None]
            columns = zip(*found) if found else [[] for _ in range(len(arrow) - kept)]
            made = [pa.array(list(c), t.type) for c, t in zip(columns, list(arrow)[kept:])]
            passed = [c if c.type == t.type else c.cast(t.type) for c, t in zip(batch.columns[:kept], arrow)]
            yield pa.RecordBatch.from_arrays([*passed, *made], schema=arrow)
        trim()

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], make, schema: str) -> DataFrame:
    """Rows of ``make() -> f(columns: dict of lists or arrays of one group) -> rows`` for each group of the integer ``keys``.

    Groups are sorted together and cut in the task, so a million small ones cost
    no call of Spark each. A group is held as a whole: callers bound its size.
    """
    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    plain = {c for c, kind in df.dtypes if kind in ("tinyint", "int", "bigint", "double")}

    def columns(table):
        return {c: table[c].to_numpy() if c in plain else table[c].to_pylist() for c in table.column_names}

    def run(batches):
        f, rest = make(), None

        def settled(table, ends):
            values, rows = columns(table), []
            for a, b in zip([0, *ends], ends):
                rows += f({c: v[a:b] for c, v in values.items()})
            made = zip(*rows) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(made, arrow)], schema=arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            by = [table[k].to_numpy() for k in keys]
            new = np.zeros(max(0, len(table) - 1), bool)
            for v in by:
                new |= v[1:] != v[:-1]
            ends = (np.flatnonzero(new) + 1).tolist()
            rest = table.slice(ends[-1] if ends else 0)
            if ends:
                yield settled(table.slice(0, ends[-1]), ends)
        if rest is not None and len(rest):
            yield settled(rest, [len(rest)])
        trim()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def trim() -> None:
    """Give a finished task's memory back: workers are reused, and what they keep adds up over stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fields(df: DataFrame, names: list[str]) -> str:
    """DDL of the named columns, for use as the head of an output schema."""
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def with_text(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """docs cut down to keep and the text, which is sent once even where it is kept; with the column to read."""
    if "text" in keep and docs.schema["text"].dataType == T.StringType():
        return docs.select(*keep), ["text"]
    return docs.select(*keep, utf8().alias("__text")), ["__text"]


def utf8(column: str = "text"):
    """A text column as UTF-8 bytes; null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
