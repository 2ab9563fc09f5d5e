"""Vector codes: integer product quantisation with value dictionaries.

Components become integers, vectors are cut into ``parts`` equal parts, and each
part is coded by its nearest codebook entry. Vectors lie in blocks of BLOCK rows;
for each dimension a block has a dictionary of its distinct integers and the
rows' codes in it. A round tabulates, per dimension, the squared differences of
every distinct integer to all entries; the distances of a part are then gathers
from these tables, added over its dimensions. Blocks are written once and read
by every round. Rounds send one row of sums for each entry and task; the driver
sees the codebooks only, ``entries`` times the dimensions.

Defined results: rows are dropped whose vector is null, empty, of a length that
``parts`` does not divide or that the vector of the smallest kept id does not
have, or which holds null, NaN, infinite components or integers so large that
squared distances could leave 63 bits. Equal distances go to the lower entry.
Ids may be null (they come first) or repeat: each row is coded, and rows with
one id start codebooks in the order of their components. With fewer rows than
``entries`` there are as many entries as rows; an empty table gives no rows and
an empty codebook. Other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, fields, freeze, trim

SCALE, BLOCK, SALT = 1024, 4096, 16


def integers(vectors: DataFrame, vec: str, parts: int) -> DataFrame:
    """vectors with an array<bigint> column ``__v``, floor(SCALE * x), of the rows that are coded."""
    x = F.transform(vec, lambda v: v.cast("double") * SCALE)
    # n squared differences of components within +-b add up to 4 * n * b * b at most, which has to be a long
    most = F.sqrt(F.lit(2.0**61) / F.size(vec))
    fits = (F.size(vec) > 0) & (F.size(vec) % parts == 0) & F.forall(x, lambda v: F.coalesce((F.abs(v) < most) & ~F.isnan(v), F.lit(False)))
    return vectors.where(F.col(vec).isNotNull() & fits).withColumn("__v", F.transform(x, lambda v: F.floor(v).cast("bigint")))


def first_entries(rows: DataFrame, key: str, entries: int) -> np.ndarray:
    """Vectors of the smallest ids, at most ``entries``; of the length of the first."""
    first = rows.select(key, "__v").orderBy(F.col(key).asc_nulls_first(), "__v").limit(1).collect()
    if not first:
        return np.zeros((0, 0), np.int64)
    found = rows.where(F.size("__v") == len(first[0]["__v"])).select(key, "__v").orderBy(F.col(key).asc_nulls_first(), "__v").limit(entries).collect()
    return np.array([r["__v"] for r in found], np.int64)


def blocks(rows: DataFrame, key: str, label: str, size: int) -> DataFrame:
    """(keys, labels, dictionaries, codes): rows packed up to BLOCK of a task; codes are 16-bit, dimension by dimension."""
    spark = rows.sparkSession
    bounded_batches(spark)
    kinds = [rows.schema[c].dataType.simpleString() for c in (key, label)]

    def run(batches):
        held, n = [], 0

        def block(table, count):
            matrix = table["__v"].combine_chunks().flatten().to_numpy().reshape(count, size)
            dictionaries, codes = [], []
            for d in range(size):
                values, code = np.unique(matrix[:, d], return_inverse=True)
                dictionaries.append(values.tolist())
                codes.append(code.astype("<u2").tobytes())
            lists = [pa.array([table[c].to_pylist()], pa.list_(table[c].type)) for c in (key, label)]
            made = [pa.array([dictionaries], pa.list_(pa.list_(pa.int64()))), pa.array([b"".join(codes)], pa.binary())]
            return pa.RecordBatch.from_arrays([*lists, *made], names=["keys", "labels", "dictionaries", "codes"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK), BLOCK)
                held, n = table.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield block(pa.Table.from_batches(held), n)
        trim()

    schema = f"keys array<{kinds[0]}>, labels array<{kinds[1]}>, dictionaries array<array<bigint>>, codes binary"
    return rows.where(F.size("__v") == size).select(key, label, "__v").mapInArrow(run, schema)


def nearest(dictionaries: list, codes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of one part of a block; codes and dictionaries of its dimensions, book: entries x dimensions."""
    spread = max(max(abs(v[0] - book[:, d]).max(), abs(v[-1] - book[:, d]).max()) for d, v in enumerate(dictionaries))
    kind = np.int32 if int(spread) ** 2 * len(dictionaries) < 1 << 31 else np.int64
    total = np.zeros((codes.shape[1], len(book)), kind)
    for d, values in enumerate(dictionaries):
        table = (np.asarray(values, np.int64)[:, None] - book[:, d][None]) ** 2
        total += table.astype(kind)[codes[d]]
    entry = total.argmin(1)  # the first of equal ones
    return entry, total[np.arange(len(total)), entry].astype(np.int64)


def _part_rows(batch, size: int, parts: int):
    """For each block of a batch: its keys, labels and, part by part, dictionaries and codes."""
    width = size // parts
    for i in range(batch.num_rows):
        dictionaries = batch["dictionaries"][i].as_py()
        codes = np.frombuffer(batch["codes"][i].as_py(), "<u2").reshape(size, -1)
        yield i, [(dictionaries[p * width : (p + 1) * width], codes[p * width : (p + 1) * width]) for p in range(parts)]


def refined(packed: DataFrame, books: np.ndarray, parts: int) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts assigned to them; books: parts x entries x width."""
    spark = packed.sparkSession
    entries, width = books.shape[1:]
    sent = spark.sparkContext.broadcast(books)

    def run(batches):
        old = sent.value
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, block in _part_rows(batch, parts * width, parts):
                for p, (dictionaries, codes) in enumerate(block):
                    entry, _ = nearest(dictionaries, codes, old[p])
                    counts[p] += np.bincount(entry, minlength=entries)
                    order = np.argsort(entry, kind="stable")
                    starts = np.flatnonzero(np.diff(entry[order], prepend=-1))
                    for d, values in enumerate(dictionaries):
                        sums[p, entry[order][starts], d] += np.add.reduceat(np.asarray(values, np.int64)[codes[d]][order], starts)
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_pydict({"part": used[:, 0].astype(np.int32), "entry": used[:, 1].astype(np.int32), "n": counts[counts > 0], "sums": list(sums[counts > 0])},
            schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
        trim()

    of_task = packed.mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    total = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
    found = of_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()  # parts * entries rows
    new = books.copy()
    for r in found:
        new[r["part"], r["entry"]] = [int(r[f"s{d}"]) // r["n"] for d in range(width)]
    sent.unpersist()
    return new


def compress(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4):
    """((key, label, code, error) of each coded row, final codebooks as parts x entries x width).

    A code has an entry's number in two hex digits for each part, so ``entries``
    is 256 at most; error is the squared distance to the coded vector.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for a part")
    schema = f"{fields(vectors, [key, label])}code string, error bigint"
    rows = integers(vectors.select(key, label, vec), vec, parts)
    start = first_entries(rows, key, entries)
    if not len(start):
        return vectors.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    size = start.shape[1]
    books = np.ascontiguousarray(start.reshape(len(start), parts, size // parts).transpose(1, 0, 2))
    packed = freeze(blocks(rows, key, label, size), "pq_blocks")
    for _ in range(rounds):
        books = refined(packed, books, parts)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for i, block in _part_rows(batch, size, parts):
                digits, error = [], 0
                for p, (dictionaries, codes) in enumerate(block):
                    entry, distance = nearest(dictionaries, codes, sent.value[p])
                    digits.append(entry.astype(np.uint8))
                    error = error + distance
                text = np.stack(digits, 1).tobytes().hex()
                code = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch["keys"][i].values, batch["labels"][i].values, pa.array(code, pa.string()), pa.array(error)], names=[key, label, "code", "error"])
        trim()

    return packed.mapInArrow(run, schema), books


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with ``label_error``, the errors of equal labels added up, nulls together; null where they leave 63 bits. A label may be that of most rows: the totals are few rows beside the coded ones and are copied to SALT shares of each label."""
    salt = F.pmod(F.xxhash64("code", "error", F.monotonically_increasing_id()), F.lit(SALT))
    total = coded.groupBy(F.col(label).alias("__label")).agg(F.try_sum("error").alias("label_error"))
    total = total.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    salted = coded.withColumn("__salt", salt)
    joined = salted.join(total, (F.col("__salt") == F.col("__share")) & F.col(label).eqNullSafe(F.col("__label")))
    return joined.select(*coded.columns, "label_error")


def codebooks_sha256(books: np.ndarray) -> str:
    """Hex digest of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
