"""Global distinct-word shuffle over whole texts.

``word_chunks`` splits every text into words and explodes them with their
positions, per chunk of at most CHUNK_BYTES of text: a document becomes a packed
array of word numbers (array index = position), the chunk's distinct words
become one row per word bucket. The table is bucketed by chunk.

``answer`` sends each distinct word of each chunk to its word bucket once
(hash of the word), where one call sees all rows of the bucket, and sends packed
answers back; ``reassemble`` meets them with the chunk's documents, which do not
move. Work per word bucket follows the number of distinct words in it, so a very
common word costs one entry per chunk. Lost executors recompute from the frozen
table; its chunk numbers do not change.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, fields, shared_dir, trim, utf8

CHUNK_BYTES = 16 << 20
DOC, WORDS = 0, 1


class Slots(dict):
    """Numbers for words in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, in the narrowest width."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return planes.reshape(width, -1).T.copy().view(f"<u{width}").ravel()


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack_ints(np.array([len(w) for w in words], np.uint32))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack_ints(data[4 : 4 + n]), dtype=np.int64).tolist()
    blob = zstandard.ZstdDecompressor().decompress(data[4 + n :])
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


def word_chunks(docs: DataFrame, keep: list[str], split, learn: Column | None = None, name: str = "words") -> DataFrame:
    """The frozen table (chunk, kind, *keep, learn, seq | bucket, words, slots, counts).

    ``split()`` returns ``f(text bytes) -> iterable of word lists``. ``counts``
    are a word's occurrences in rows where ``learn`` holds.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    schema = "chunk bigint, kind tinyint, " + fields(docs, keep) + "learn boolean, seq binary, bucket int, words binary, slots binary, counts binary"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    k = len(keep)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    def flush(chunk, slots, rows, seqs):
        for i in range(0, len(rows), 512):
            yield table([(chunk, DOC, *r, pack_ints(s), None, None, None, None) for r, s in zip(rows[i : i + 512], seqs[i : i + 512])])
        learnt = [s for r, s in zip(rows, seqs) if r[-1] and len(s)]
        counts = np.bincount(np.concatenate(learnt), minlength=len(slots)) if learnt else np.zeros(len(slots), np.int64)
        words = [w.encode() if isinstance(w, str) else w for w in slots]
        where = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order])) + 1
        out = []
        for part in np.split(order, cuts) if len(order) else []:
            part = np.array(sorted(part.tolist(), key=words.__getitem__))
            out.append((chunk, WORDS, *[None] * k, None, None, int(where[part[0]]), pack_words([words[i] for i in part]), pack_ints(part), pack_ints(counts[part])))
        for i in range(0, len(out), 64):
            yield table(out[i : i + 64])

    def run(batches):
        f, n = split(), TaskContext.get().partitionId() << 24
        slots, rows, seqs, size = Slots(), [], [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                text, number = r[-1], slots.__getitem__
                parts = [np.fromiter(map(number, words), np.uint32, len(words)) for words in f(text)]
                seqs.append(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
                rows.append(r[:-1])
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from flush(n, slots, rows, seqs)
                    slots, rows, seqs, size, n = Slots(), [], [], 0, n + 1
        if rows:
            yield from flush(n, slots, rows, seqs)
        slots, rows, seqs = None, None, None
        trim()

    flag = F.lit(False) if learn is None else F.coalesce(learn, F.lit(False))
    out = docs.select(*keep, flag.alias("learn"), utf8().alias("__text")).mapInArrow(run, schema)
    at = f"{name}_{uuid.uuid4().hex}"
    out.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{at}").bucketBy(parts, "chunk").saveAsTable(at)
    return spark.table(at)


def answer(chunks: DataFrame, make, extra: str = "") -> DataFrame:
    """(chunk, bucket, answer, *extra): ``make()`` gives ``f(messages) -> iterable of rows``; messages are (chunk, words, counts) of one word bucket."""
    schema = "chunk bigint, bucket int, answer binary" + (", " + extra if extra else "")
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        messages = zip(group["chunk"].to_pylist(), group["words"].to_pylist(), group["counts"].to_pylist())
        rows = [(r[0], bucket, *r[1:]) for r in make()(messages)]
        trim()
        return pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    return chunks.where(F.col("kind") == WORDS).select("bucket", "chunk", "words", "counts").groupBy("bucket").applyInArrow(run, schema)


def reassemble(chunks: DataFrame, answers: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """Rows of ``make() -> f(document rows, word rows, {bucket: answer})`` for each chunk; ``columns`` are those of the chunk table to read."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table):
        kind = np.array(left["kind"].to_pylist())
        take = [c for c in left.column_names if c not in ("chunk", "kind")]
        got = dict(zip(right["bucket"].to_pylist(), right["answer"].to_pylist()))
        part = [left.select(take).filter(pa.array(kind == k)).to_pylist() for k in (DOC, WORDS)]
        rows = list(make()(*part, got))
        part = got = None
        trim()
        columns = zip(*rows) if rows else [[] for _ in arrow]
        return pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, arrow)], schema=arrow)

    docs = chunks.select("chunk", "kind", *columns)
    return docs.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "answer").groupBy("chunk")).applyInArrow(run, schema)
