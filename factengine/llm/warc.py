"""Merkle fixity audit of WARC replicas, in DataFrame operations only.

Records are dealt to archives by a prefix of their key's hash, whose length
follows the number of records, and stand in each archive in key order at running
offsets. A leaf hashes a record's digest with its offset, length and number of copies; a
node hashes up to FANOUT children in order, and each level is written once. ``audit`` compares archive roots and
descends level by level, joining only the children of mismatching nodes.

Defined results: null urls and payloads are written as empty; identical records
are stored once with their number of copies, and copies that a replica lost are
found; a record that one replica lacks shows as a null digest; records with one
key and different bytes are held against each other in the order of their digests; empty tables give empty trees and no findings.
"""

from pyspark.sql import DataFrame, functions as F, Window

from .common import freeze

FANOUT, ARCHIVE_RECORDS = 16, 512


def with_record_ids(pages: DataFrame, payload: str = "html") -> DataFrame:
    """pages + key: the record id given at capture, which every replica carries on."""
    parts = [F.coalesce(c, F.lit("")) for c in (F.col("page_id").cast("string"), F.col("url"), F.sha2(payload, 256))]
    return pages.select("page_id", "url", payload, F.sha2(F.concat_ws("\n", *parts), 256).alias("key"))


def warc_records(pages: DataFrame, payload: str = "html") -> DataFrame:
    """(page_id, url, key, digest, length, copies): WARC resource records, hashed over header and payload."""
    url, body = F.coalesce("url", F.lit("")), F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), F.col("key"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, body, F.lit("\r\n\r\n"))
    rows = pages.select("page_id", "url", "key", F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("bigint").alias("length"))
    return rows.groupBy("page_id", "url", "key", "digest", "length").agg(F.count("*").alias("copies"))


def archives(records: DataFrame, digits: int) -> DataFrame:
    """records + (archive, position, offset); archives hold about ARCHIVE_RECORDS records."""
    w = Window.partitionBy("archive").orderBy("key", "digest", "page_id", "url")
    out = records.withColumn("archive", F.substring("key", 1, digits))
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("position", F.row_number().over(w).cast("bigint") - 1).withColumn("offset", before)


def archive_digits(n: int) -> int:
    """Hex digits that deal n records to archives of about ARCHIVE_RECORDS."""
    digits = 0
    while 16**digits * ARCHIVE_RECORDS < n:
        digits += 1
    return digits


def tree(placed: DataFrame, levels: int) -> list[DataFrame]:
    """(level, archive, node, hash, start, end) of each level, from leaves (level 0) to roots; a node covers the bytes [start, end)."""
    leaf = F.sha2(F.concat_ws(":", "offset", "length", "digest", "copies"), 256)
    level = placed.select(F.lit(0).alias("level"), "archive", F.col("position").alias("node"), leaf.alias("hash"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    level = freeze(level, "warc_level")
    out = [level]
    for k in range(1, levels + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # at most FANOUT
        level = level.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("parent")).agg(
            F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end")
        )
        level = freeze(level.select(F.lit(k).alias("level"), "archive", F.col("parent").alias("node"), "hash", "start", "end"), "warc_level")
        out.append(level)
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records on which two replicas (from warc_records) differ: page_id, url, key, archive, position, offset, length, expected, found (digests), expected_copies, found_copies."""
    n, m = left.count(), right.count()
    digits = archive_digits(max(n, m))
    a, b = (freeze(archives(x, digits), "warc_replica") for x in (left, right))
    most = max([0, *(x.agg(F.max("position")).first()[0] or 0 for x in (a, b))])
    levels = 0
    while FANOUT**levels <= most:
        levels += 1
    ta, tb = (tree(x, levels) for x in (a, b))
    wrong = None
    for k in range(levels, -1, -1):
        x = ta[k].select("archive", "node", F.col("hash").alias("hash_a"))
        y = tb[k].select("archive", "node", F.col("hash").alias("hash_b"))
        if wrong is not None:  # only children of mismatching nodes
            parents = wrong.select("archive", F.col("node").alias("parent"))
            x, y = (t.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(parents, ["archive", "parent"], "left_semi").drop("parent") for t in (x, y))
        differ = x.join(y, ["archive", "node"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        wrong = freeze(differ.select("archive", "node"), "warc_mismatch")
    leaves = wrong.select("archive", F.col("node").alias("position"))
    nth = F.row_number().over(Window.partitionBy("archive", "key").orderBy("digest", "page_id", "url")).alias("nth")
    sides = (x.join(leaves, ["archive", "position"], "left_semi").select("page_id", "url", "key", "archive", "position", "offset", "length", "digest", "copies", nth) for x in (a, b))
    expected, found = (x.alias(name) for x, name in zip(sides, "ef"))
    both = expected.join(found, (F.col("e.key") == F.col("f.key")) & (F.col("e.nth") == F.col("f.nth")), "full")
    pick = lambda c: F.coalesce(f"e.{c}", f"f.{c}").alias(c)
    digests = [F.col("e.digest").alias("expected"), F.col("f.digest").alias("found"), F.col("e.copies").alias("expected_copies"), F.col("f.copies").alias("found_copies")]
    out = both.select(*map(pick, ["page_id", "url", "key", "archive", "position", "offset", "length"]), *digests)
    return out.where(~F.col("expected").eqNullSafe(F.col("found")) | ~F.col("expected_copies").eqNullSafe(F.col("found_copies")))
