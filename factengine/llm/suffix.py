"""Exact substring dedup with suffix arrays: bytes of passages that also start in a document with a smaller id.

1. Texts are frozen in chunks; exact copies of a text are settled by its hash.
2. In every 50-byte window the GRAM-byte string with the smallest hash is its
   anchor; equal windows have equal anchors. Anchor hashes are counted per hash
   bucket, and each chunk learns which of its anchors other documents share.
3. Around each shared anchor, the stretch of text that its windows can span is a
   context. Hashes of contexts are dealt by anchor into buckets, which answer with
   the smallest id that has a context: its other owners lose all of its windows.
   The texts of contexts whose anchor has others that go on alike on one side
   (as contexts with a common window do) follow into the same bucket,
   so all equal windows meet in one bucket, and are cut there into shards of
   SHARD_BYTES. Each shard gets a suffix array by Larsson-Sadakane
   refinement and common prefixes by Kasai's method; suffixes with a common prefix
   of 50 bytes are one window, with its smallest id. Shards are merged by binary
   search of one shard's sorted windows in the others'.
4. The windows that a smaller id has go back to their chunk, are united, and the
   bytes they cover are cut out of the whole text.

Data per anchor is bounded by the context length; hot passages have few distinct
contexts, however many documents share them.

Defined results: null and empty texts have nothing to remove; rows with equal ids
never remove from each other; a null id counts as larger than all others.
"""

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .chunks import pack_ints, unpack_ints
from .common import bounded_batches, fields, freeze, shared_dir, trim, utf8

WINDOW, GRAM = 50, 16
HALF = (WINDOW - GRAM) // 2  # a window has so many bytes more than its anchor on one side at least
SPAN = WINDOW - GRAM  # a context has SPAN bytes on both sides of its anchor
CONTEXT = 2 * SPAN + GRAM
CHUNK_BYTES, SHARD_BYTES, STEP = 8 << 20, 1 << 20, 1 << 20
NO_ID = (1 << 63) - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_KEPT = np.uint64((1 << 48) - 1)
_PLACE = np.uint64((1 << 31) - 1)


@lru_cache(1)
def _powers():
    """Powers of _P and of its inverse mod 2**64, for a segment."""
    size = STEP + WINDOW
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_P, np.uint64(pow(int(_P), -1, 1 << 64))))


def _segment_anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    up, down = _powers()
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[raw] * up[:n], dtype=np.uint64)])
    grams = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, have = WINDOW - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[: n - WINDOW + 1], low[width - have :][: n - WINDOW + 1])
    inside = np.ones(len(low), bool)
    for e in ends.tolist():  # windows that would cross a document's end
        inside[max(0, e - WINDOW + 1) : e] = False
    at = np.unique((low[inside] & _PLACE).astype(np.int64))
    return at, grams[at] & _KEPT


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, 48-bit hash) of the anchors of all windows within documents; raw holds the documents one after the other. Segments overlap by a window, so none is missed."""
    found = []
    for at in range(0, len(raw) - WINDOW + 1, STEP):
        part = raw[at : at + STEP + WINDOW - 1]
        place, hashes = _segment_anchors(part, ends[(ends > at) & (ends < at + len(part))] - at)
        found.append((place + at, hashes))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
    return place, np.concatenate([x for _, x in found])[first]


# --- suffix arrays ---------------------------------------------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each position) by Larsson-Sadakane refinement: only groups that are not yet single are sorted again, by the rank at twice the depth.

    Refinement stops at a depth of WINDOW or more; suffixes that agree so far keep one rank.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes of nine bits
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    start = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = start[np.cumsum(fresh) - 1]  # a group's rank is its first place
    depth = 7
    size = np.diff(np.append(start, n))
    places = np.flatnonzero(np.repeat(size > 1, size))
    while len(places) and depth < WINDOW:
        suffix = order[places]
        next_ = suffix + depth
        pair = rank[suffix] * (n + 1) + np.where(next_ < n, rank[np.minimum(next_, n - 1)] + 1, 0)
        by = np.argsort(pair)
        suffix, pair = suffix[by], pair[by]
        order[places] = suffix
        begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        size = np.diff(np.append(begin, len(places)))
        rank[suffix] = np.repeat(places[begin], size)
        places = places[np.repeat(size > 1, size)]
        depth *= 2
    return order, rank


def kasai(text: np.ndarray, order: np.ndarray, rank: np.ndarray, stretch: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, by Kasai's method on stretches of ``stretch`` positions side by side; values stop at WINDOW.

    Within a stretch a position's value is at least that of the position before,
    less one, so characters are compared on from there. Suffixes of one rank share
    WINDOW bytes without a comparison; as their own order is open, the suffix after
    one of them may be the first of its rank with a smaller value, and starts anew.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    tied = np.zeros(n, bool)
    tied[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    out = np.zeros(n, np.int8)
    heads = np.arange(0, n, stretch)
    have = np.zeros(len(heads), np.int64)
    was = np.zeros(len(heads), bool)
    padded = np.concatenate([text.astype(np.int16), np.full(WINDOW + 1, -1, np.int16)])
    for step in range(stretch):
        i = heads + step
        i = i[i < n]
        have, was = have[: len(i)], was[: len(i)]
        same, j = tied[i], before[i]
        have = np.where(same, WINDOW, np.where(was | (j < 0), 0, np.maximum(have - 1, 0)))
        go = np.flatnonzero(~same & (j >= 0))
        while len(go):
            a, b = padded[i[go] + have[go]], padded[j[go] + have[go]]
            go = go[(a == b) & (a >= 0)]
            have[go] += 1
            go = go[have[go] < WINDOW]
        was = same
        out[i] = have
    return out


def shard_windows(contexts: list[bytes], ids: np.ndarray):
    """Sorted distinct windows of a shard of contexts: (text, place of each window in it, smallest id of each, window number of each (context, offset) or -1)."""
    length = np.array([len(c) for c in contexts])
    start = np.cumsum(length) - length
    text = np.frombuffer(b"".join(contexts), np.uint8)
    order, rank = suffix_array(text)
    common = kasai(text, order, rank, CONTEXT)
    owner = np.repeat(np.arange(len(contexts)), length)
    left = np.repeat(start + length, length) - np.arange(len(text))
    # a window begins where the common prefix with the suffix before is short
    group = np.cumsum(common[order] < WINDOW)
    whole = left[order] >= WINDOW
    places, group = order[whole], group[whole]
    of = np.full((len(contexts), CONTEXT - WINDOW + 1), -1, np.int32)
    if not len(places):
        return text, places, np.zeros(0, np.int64), of
    begin = np.concatenate([[True], group[1:] != group[:-1]])
    owners = owner[places]
    of[owners, places - start[owners]] = np.cumsum(begin) - 1
    begin = np.flatnonzero(begin)
    return text, places[begin], np.minimum.reduceat(ids[owners], begin), of


def _keys(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Windows as seven big-endian numbers each, which order as their bytes do."""
    wide = np.zeros((len(places), 56), np.uint8)
    wide[:, :WINDOW] = np.lib.stride_tricks.sliding_window_view(text, WINDOW)[places]
    return wide.view(">u8").astype(np.uint64)


def search(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Binary search of the windows b in a shard's sorted windows a (from _keys): place, or -1 where it has none."""
    if not len(a):
        return np.full(len(b), -1, np.int64)
    lo, hi = np.searchsorted(a[:, 0], b[:, 0]), np.searchsorted(a[:, 0], b[:, 0], side="right")
    open_ = np.flatnonzero(lo < hi)
    place = np.full(len(b), -1, np.int64)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        probe, want = a[mid], b[open_]
        differ = probe != want
        found = ~differ.any(axis=1)
        place[open_[found]] = mid[found]
        at = differ.argmax(axis=1)
        rows = np.arange(len(open_))
        less = probe[rows, at] < want[rows, at]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[~found]
        open_ = open_[lo[open_] < hi[open_]]
    return place


def earlier_windows(contexts: list[bytes], ids: np.ndarray) -> np.ndarray:
    """For each context a bit mask of its offsets whose window some smaller id has too, over all shards of the bucket."""
    shards, at = [], 0
    while at < len(contexts):
        end, size = at, 0
        while end < len(contexts) and size < SHARD_BYTES:
            size += len(contexts[end])
            end += 1
        shards.append((at, end, *shard_windows(contexts[at:end], ids[at:end])))
        at = end
    keys = [_keys(text, places) for _, _, text, places, _, _ in shards] if len(shards) > 1 else []
    for i in range(len(keys)):
        least = shards[i][4]
        for j in range(i + 1, len(keys)):
            smallest = shards[j][4]
            place = search(keys[i], keys[j])
            hit = place >= 0
            both = np.minimum(least[place[hit]], smallest[hit])
            least[place[hit]] = both
            smallest[hit] = both
    mask = np.zeros(len(contexts), np.int64)
    for at, end, _, _, least, of in shards:
        known = of >= 0
        earlier = known & (least[np.where(known, of, 0)] < ids[at:end, None]) if len(least) else known
        mask[at:end] = (earlier << np.arange(earlier.shape[1])).sum(axis=1)
    return mask


# --- jobs ------------------------------------------------------------------


def _rows(schema: str):
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def table(rows, kind=pa.Table):
        columns = list(zip(*rows)) if rows else [[] for _ in arrow]
        return kind.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return table


def _text_chunks(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Frozen (chunk, row, *keep, id, hash, text), bucketed by chunk."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "chunk bigint, row int, " + fields(docs, keep) + "id bigint, hash string, text binary"
    make = _rows(schema)

    def run(batches):
        chunk, row, size = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size and size + len(r[-1]) > CHUNK_BYTES:
                    chunk, row, size = chunk + 1, 0, 0
                out.append((chunk, row, *r))
                row, size = row + 1, size + len(r[-1])
            yield make(out, pa.RecordBatch)

    ready = docs.select(*keep, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.sha2(utf8(), 256).alias("hash"), utf8().alias("text"))
    name = f"texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = ready.mapInArrow(run, schema).write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    out.bucketBy(parts, "chunk").saveAsTable(name)
    return spark.table(name)


#: What bucket jobs send to a chunk: packed arrays a and b of one kind.
MAIL = "chunk bigint, kind string, bucket int, a binary, b binary"


def _mail(right: pa.Table) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {"copies": [], "anchors": [], "first": [], "mask": []}
    for kind, *rest in zip(*(right[c].to_pylist() for c in ("kind", "bucket", "a", "b"))):
        out[kind].append(tuple(rest))
    return out


def _longs(values: np.ndarray) -> bytes:
    return pack_ints(values.astype(np.int64).view(np.uint64))


def _ids(data: bytes) -> np.ndarray:
    return unpack_ints(data).astype(np.uint64).view(np.int64)


def _pack_sorted(values: np.ndarray) -> bytes:
    return pack_ints(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data).astype(np.uint64), dtype=np.uint64)


class Chunk:
    """A chunk's documents that take part, joined, with the anchors they share with other documents."""

    def __init__(self, left: pa.Table, mail: dict[str, list[tuple]]):
        self.chunk = left["chunk"][0].as_py()
        self.copies = {r for _, a, _ in mail["copies"] for r in _ids(a).tolist()}
        rows, texts = left["row"].to_pylist(), left["text"].to_pylist()
        own = [i for i, (r, t) in enumerate(zip(rows, texts)) if r not in self.copies and len(t) >= WINDOW]
        self.rows = np.array([rows[i] for i in own], np.int64)
        self.data = b"".join(texts[i] for i in own)
        self.ends = np.cumsum([len(texts[i]) for i in own], dtype=np.int64)
        self.at, self.anchor = anchors(np.frombuffer(self.data, np.uint8), self.ends)
        ids = left["id"].to_numpy() if "id" in left.column_names else np.zeros(len(rows), np.int64)
        self.ids = ids[own]

    def keep_shared(self, mail) -> None:
        """Only anchors that the mail names; ``key`` hashes each one's context, data[lo:hi]."""
        known = np.sort(np.concatenate([_unpack_sorted(a) for _, a, _ in mail["anchors"]] or [np.zeros(0, np.uint64)]))
        if len(known):
            take = known[np.searchsorted(known, self.anchor).clip(max=len(known) - 1)] == self.anchor
        else:
            take = np.zeros(len(self.at), bool)
        self.at, self.anchor = self.at[take], self.anchor[take]
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        starts = np.concatenate([[0], self.ends])
        self.begin = starts[self.doc]
        self.lo, self.hi = np.maximum(self.at - SPAN, self.begin), np.minimum(self.at + GRAM + SPAN, starts[1:][self.doc])
        contexts = (self.data[x:y] for x, y in zip(self.lo.tolist(), self.hi.tolist()))
        self.key = np.fromiter(map(xxhash.xxh3_64_intdigest, contexts), np.uint64, len(self.at))
        self.id = self.ids[self.doc]

    def sides(self, x: np.ndarray) -> list[np.ndarray]:
        """Hashes of the occurrences' anchors with HALF more bytes to the left and to the right; 0 where a document ends before. Every window of an anchor holds one of the two."""
        out = []
        for a, b in ((self.at[x] - HALF, self.at[x] + GRAM), (self.at[x], self.at[x] + GRAM + HALF)):
            there = (a >= self.lo[x]) & (b <= self.hi[x])
            parts = (self.data[i:j] if ok else b"" for i, j, ok in zip(a.tolist(), b.tolist(), there.tolist()))
            out.append(np.where(there, np.fromiter(map(xxhash.xxh32_intdigest, parts), np.uint32, len(x)).clip(min=1), np.uint32(0)))
        return out

    def entries(self, buckets: int):
        """(order of occurrences, entry of each in that order, first occurrence of each entry): entries are the chunk's distinct (anchor, context), by bucket."""
        bucket = self.anchor % np.uint64(buckets)
        order = np.lexsort((self.id, self.key, self.anchor, bucket))
        a, k = self.anchor[order], self.key[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (k[1:] != k[:-1])]) if len(a) else np.zeros(0, bool)
        return order, np.cumsum(new) - 1, order[new], bucket[order[new]].astype(np.int64)


def _cogroup(chunks: DataFrame, mail: DataFrame, columns: list[str], f, schema: str) -> DataFrame:
    """f(left, mail) -> rows for every chunk."""
    table = _rows(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(f(left, _mail(right))) if len(left) else []
        trim()
        return table(rows)

    return chunks.select("chunk", "row", "text", *columns).groupBy("chunk").cogroup(mail.groupBy("chunk")).applyInArrow(run, schema)


def _shared_anchors(chunks: DataFrame, copies: DataFrame, buckets: int) -> DataFrame:
    """MAIL of kind anchors: packed hashes of each chunk's anchors that several documents have."""

    def count(left, mail):
        c = Chunk(left, mail)
        doc = np.searchsorted(c.ends, c.at, side="right")
        by = np.lexsort((doc, c.anchor))
        h, d = c.anchor[by], doc[by]
        several = np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])
        distinct = np.unique(h)
        more = np.isin(distinct, several, assume_unique=True)
        part = (distinct % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
            yield c.chunk, "", int(part[at[0]]), _pack_sorted(distinct[at[~more[at]]]), _pack_sorted(distinct[at[more[at]]])

    table = _rows(MAIL)

    def shared(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        once, more = ([_unpack_sorted(x) for x in group[k].to_pylist()] for k in ("a", "b"))
        found, n = np.unique(np.concatenate([*once, *more, *more]), return_counts=True)
        found = found[n > 1]
        hits = [np.sort(np.concatenate([a[np.isin(a, found, assume_unique=True)], b])) for a, b in zip(once, more)]
        return table([(c, "anchors", bucket, _pack_sorted(x), None) for c, x in zip(group["chunk"].to_pylist(), hits) if len(x)])

    seen = _cogroup(chunks, copies, [], count, MAIL)
    return seen.groupBy("bucket").applyInArrow(shared, MAIL)


def _first_ids(chunks: DataFrame, mail: DataFrame, buckets: int) -> DataFrame:
    """MAIL of kind first: for each of a chunk's entries the smallest id that has this context, and whether the chunk is to send its text, because the anchor has other contexts that agree with it on one side."""

    def send(left, mail):
        c = Chunk(left, mail)
        c.keep_shared(mail)
        _, _, head, bucket = c.entries(buckets)
        for at in np.split(np.arange(len(head)), np.flatnonzero(np.diff(bucket)) + 1) if len(head) else []:
            x = head[at]
            left_, right_ = c.sides(x)
            yield c.chunk, int(bucket[at[0]]), _pack_sorted(c.anchor[x]), c.key[x].tobytes(), _longs(c.id[x]), left_.tobytes(), right_.tobytes()

    table = _rows(MAIL)

    def settle(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        parts = [_unpack_sorted(x) for x in group["anchors"].to_pylist()]
        anchor = np.concatenate(parts)
        key = np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint64)
        ids = np.concatenate([_ids(x) for x in group["ids"].to_pylist()])
        by = np.lexsort((ids, key, anchor))
        a, k = anchor[by], key[by]
        other = np.concatenate([[True], a[1:] != a[:-1]])
        new = other | np.concatenate([[True], k[1:] != k[:-1]])
        first = np.empty(len(by), np.int64)
        first[by] = ids[by][np.flatnonzero(new)][np.cumsum(new) - 1]
        several = np.zeros(len(by), bool)
        for name in ("lefts", "rights"):  # other contexts of the anchor that go on alike on one side
            side = np.frombuffer(b"".join(group[name].to_pylist()), np.uint32)
            by = np.lexsort((key, side, anchor))
            same = np.concatenate([[True], (anchor[by][1:] != anchor[by][:-1]) | (side[by][1:] != side[by][:-1])])
            new = same | np.concatenate([[True], key[by][1:] != key[by][:-1]])
            at = np.cumsum(same) - 1
            several[by] |= (np.bincount(at, new) > 1)[at] & (side[by] > 0)
        want = (several & (ids == first)).astype(np.uint8)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        pairs = zip(group["chunk"].to_pylist(), np.split(first, cuts), np.split(want, cuts))
        return table([(c, "first", bucket, _longs(f), pack_ints(w)) for c, f, w in pairs])

    seen = _cogroup(chunks, mail, ["id"], send, "chunk bigint, bucket int, anchors binary, keys binary, ids binary, lefts binary, rights binary")
    return seen.groupBy("bucket").applyInArrow(settle, MAIL)


def _firsts(mail) -> tuple[np.ndarray, np.ndarray]:
    """(first, want) of all entries, in entry order."""
    parts = sorted(mail["first"])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([_ids(a) for _, a, _ in parts]), np.concatenate([unpack_ints(b) for _, _, b in parts]) > 0


def _masks(chunks: DataFrame, mail: DataFrame, buckets: int) -> DataFrame:
    """MAIL of kind mask: by suffix arrays, which windows of a context smaller ids have in other contexts of the anchor."""

    def send(left, mail):
        c = Chunk(left, mail)
        c.keep_shared(mail)
        _, _, head, bucket = c.entries(buckets)
        first, want = _firsts(mail)
        for i in np.flatnonzero(want).tolist():
            x = head[i]
            yield int(bucket[i]), c.chunk, int(c.anchor[x]), int(c.key[x].view(np.int64)), c.data[c.lo[x] : c.hi[x]], int(first[i])

    table = _rows(MAIL)

    def settle(group: pa.Table) -> pa.Table:
        group = group.sort_by("anchor")
        bucket = group["bucket"][0].as_py()
        mask = earlier_windows(group["context"].to_pylist(), group["first"].to_numpy())
        chunk, key = group["chunk"].to_numpy(), group["key"].to_numpy()
        hit = np.flatnonzero(mask)
        hit = hit[np.argsort(chunk[hit], kind="stable")]
        out = []
        for at in np.split(hit, np.flatnonzero(np.diff(chunk[hit])) + 1) if len(hit) else []:
            out.append((int(chunk[at[0]]), "mask", bucket, key[at].tobytes(), mask[at].tobytes()))
        return table(out)

    texts = _cogroup(chunks, mail, ["id"], send, "bucket int, chunk bigint, anchor bigint, key bigint, context binary, first bigint")
    return texts.groupBy("bucket").applyInArrow(settle, MAIL)


def _covered(c: Chunk, mail, buckets: int) -> np.ndarray:
    """Which bytes of the chunk's joined texts go."""
    edge = np.zeros(len(c.data) + 1, np.int64)
    c.keep_shared(mail)
    order, entry, head, _ = c.entries(buckets)
    first, _ = _firsts(mail)
    if len(order):
        mask = np.zeros(len(head), np.int64)
        keys = np.frombuffer(b"".join(a for _, a, _ in mail["mask"]), np.int64)
        bits = np.frombuffer(b"".join(b for _, _, b in mail["mask"]), np.int64)
        mine = c.key[head].view(np.int64)
        if len(keys):  # short texts may have one context around several anchors: their masks add up
            keys, start = np.unique(keys[by := np.argsort(keys, kind="stable")], return_index=True)
            bits = np.bitwise_or.reduceat(bits[by], start)
            place = np.searchsorted(keys, mine).clip(max=len(keys) - 1)
            mask = np.where(keys[place] == mine, bits[place], 0)
        for at in range(0, len(order), 1 << 16):  # occurrences with their entries, some at a time
            x, e = order[at : at + (1 << 16)], entry[at : at + (1 << 16)]
            windows = np.where(c.id[x] > first[e], (1 << (CONTEXT - WINDOW + 1)) - 1, mask[e])
            some = np.flatnonzero(windows)
            x, windows = x[some], windows[some]
            offset = np.arange(CONTEXT - WINDOW + 1)
            gone = ((windows[:, None] >> offset) & 1 == 1) & (offset <= (c.hi[x] - c.lo[x])[:, None] - WINDOW)
            start = (c.lo[x][:, None] + offset)[gone]
            edge += np.bincount(start, minlength=len(edge)) - np.bincount(start + WINDOW, minlength=len(edge))
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep + (n_bytes, n_removed, n_spans, kept binary): texts without the bytes of passages that a smaller id has too."""
    keep = list(keep)
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = _text_chunks(docs, keep)

    # exact copies: only a text's smallest id takes part; the others lose everything
    heads = chunks.groupBy("hash").agg(F.min("id").alias("head"), F.count("*").alias("n")).where(F.col("n") > 1)
    copies = chunks.select("chunk", "row", "id", "hash").join(heads.select("hash", "head"), "hash").where(F.col("id") > F.col("head"))
    table = _rows(MAIL)

    def pack(group: pa.Table) -> pa.Table:
        return table([(group["chunk"][0].as_py(), "copies", 0, _longs(group["row"].to_numpy()), None)])

    copies = freeze(copies.select("chunk", F.col("row").cast("bigint").alias("row")).groupBy("chunk").applyInArrow(pack, MAIL), "copies")
    mail = copies.unionAll(freeze(_shared_anchors(chunks, copies, buckets), "anchors"))
    mail = mail.unionAll(freeze(_first_ids(chunks, mail, buckets), "first"))
    mail = mail.unionAll(freeze(_masks(chunks, mail, buckets), "masks"))

    def cut(left, mail):
        c = Chunk(left, mail)
        gone = _covered(c, mail, buckets)
        span = dict(zip(c.rows.tolist(), zip(np.concatenate([[0], c.ends[:-1]]).tolist(), c.ends.tolist())))
        values = zip(left["row"].to_pylist(), left["text"].to_pylist(), *(left[k].to_pylist() for k in keep))
        for row, text, *kept in values:
            if row in c.copies and len(text) >= WINDOW:
                yield *kept, len(text), len(text), 1, b""
                continue
            lost = gone[slice(*span.get(row, (0, 0)))]
            if not lost.any():
                yield *kept, len(text), 0, 0, text
                continue
            spans = int((lost & ~np.concatenate([[False], lost[:-1]])).sum())
            yield *kept, len(text), int(lost.sum()), spans, np.frombuffer(text, np.uint8)[~lost].tobytes()

    return _cogroup(chunks, mail, ["id", *(k for k in keep if k not in ("row", "text", "id"))], cut, fields(docs, keep) + "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
