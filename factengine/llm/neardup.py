"""MinHash near-dedup with odd sketches.

Each text's set of word shingles is hashed to MinHash samples; BANDS groups of
ROWS samples find candidates, and the samples folded into a parity bitmap (an odd
sketch) estimate a candidate pair's similarity by the population count of the
XOR. What the estimate leaves (ESTIMATE, seven standard deviations below the
threshold 0.8) is confirmed on the full shingle sets.

Equal sets are one class (128-bit digest of the set) before any pairing; classes
are numbered once, in a frozen table. Links are found in three steps, and after
each one what is linked is one component:

1. A band bucket is a star around three of its classes, so it gives candidates per
   member, not per pair; each class is held against its best hub by sketch.
2. In buckets of more than a block, each class is held against a block of hubs of
   the largest bucket it is in.
3. Buckets that still hold several components are compared whole: members outside
   the largest component, in blocks, against all members, in blocks.

In steps 2 and 3 the sketches first leave only members with a candidate in another
component; their full sets are then counted against each other exactly. A block
returns a forest, at most a link for each component in it, so links grow with the
members of a group and not with its pairs. Blocks are bounded in members and in
shingles; a group with any share of all rows is spread over tasks.
The chance that no band holds a pair of similarity 0.8 is below 1e-6.

Defined results: null, empty and blank texts have no shingles, are linked with
nothing and are kept; equal texts are linked; of repeated rows with one id all
are ``kept``, and one is ``first``; null ids come after all others; an empty table
gives no rows.
"""

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import fields, freeze, map_groups, map_rows, utf8
from .lm import split_words

BANDS, ROWS, SKETCH, SALT = 48, 6, 1024, 256
BLOCK, BLOCK_SHINGLES, SLICE = 512, 1 << 20, 4096  #: members and shingles of a block; shingles counted at once
ESTIMATE = 0.6
_RNG = np.random.default_rng(11)
_A = (_RNG.integers(1, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]
_BIT = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _Q
    return x ^ (x >> np.uint64(29))


class _Hashes(dict):
    """Word hashes; emptied when it has a quarter of a million words."""

    def __missing__(self, word):
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingler(k: int):
    """f(text) -> sorted distinct hashes of its k-word shingles (fewer words: all of them as one)."""
    words, number = split_words(), _Hashes().__getitem__

    def f(text: bytes) -> np.ndarray:
        parts = [np.fromiter(map(number, ws), np.uint64, len(ws)) for ws in words(text)]
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if not len(h):
            return h
        width = min(k, len(h))
        out = np.zeros(len(h) - width + 1, np.uint64)
        for j in range(width):
            out = out * _P + h[j : j + len(out)]
        return np.unique(_mix(out))

    return f


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set as two longs."""
    return struct.unpack(">qq", xxhash.xxh3_128_digest(shingles.tobytes()))


def samples(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash samples; half of them from either half of the hashes."""
    half = BANDS * ROWS // 2
    out = np.full(2 * half, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        for lo, x in ((0, part.astype(np.uint32)), (half, (part >> np.uint64(32)).astype(np.uint32))):
            out[lo : lo + half] = np.minimum(out[lo : lo + half], (_A[lo : lo + half] * x + _B[lo : lo + half]).min(axis=1))
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    rows = s.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * _P + rows[:, j])
    return key.view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of SKETCH bits, as longs: each sample flips one bit."""
    bit = (_mix(s.astype(np.uint64) * _P + _BIT) % np.uint64(SKETCH)).astype(np.int64)
    odd = np.bincount(bit, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _estimate(a: str, b: str):
    """Similarity by the odd sketches of two columns: 1 + n / (4 k) ln(1 - 2 z / n)."""
    z = sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH // 64))
    inside = F.greatest(F.lit(1.0) - F.lit(2.0 / SKETCH) * z, F.lit(1e-9))
    return F.lit(1.0) + F.lit(SKETCH / (4.0 * BANDS * ROWS)) * F.log(inside)


#: The most differing bits of two sketches whose estimate is ESTIMATE at least.
FAR = int(SKETCH / 2 * (1 - np.exp((ESTIMATE - 1) * 4 * BANDS * ROWS / SKETCH)))


def _sets(signed: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of the wanted classes, from the text of each one's first row."""
    first = classes.select("cls", F.col("first.row").alias("row")).join(wanted.distinct(), "cls", "left_semi")
    texts = signed.select("row", utf8().alias("text")).join(first, "row")

    def make():
        shingles = shingler(k)
        return lambda r: (shingles(r[0]).tobytes(),)

    return freeze(map_rows(texts.select("cls", "text"), make, "cls bigint, shingles binary", kept=1), "shingle_sets")


def _similar(full: np.ndarray, mine: np.ndarray, percent: int) -> bool:
    both = int((full[np.searchsorted(full, mine).clip(max=len(full) - 1)] == mine).sum())
    return 100 * both >= percent * (len(full) + len(mine) - both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the candidate pairs whose full sets are similar; b is the hub, sent once for SALT members."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    members = pairs.join(salts, "b").select(F.col("a").alias("cls"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.lit(True).alias("member"))
    hubs = salts.select(F.col("b").alias("cls"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    dealt = members.unionAll(hubs).join(sets, "cls").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member", "cls")

    def run(batches):
        at, full = None, None
        for batch in batches:
            out = []
            for cls, hub, salt, member, data in zip(*(c.to_pylist() for c in batch.columns)):
                if not member:
                    at, full = (hub, salt), np.frombuffer(data, np.uint64)
                elif at == (hub, salt) and _similar(full, np.frombuffer(data, np.uint64), percent):
                    out.append((cls, hub))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.select("cls", "hub", "salt", "member", "shingles").mapInArrow(run, "a bigint, b bigint")


def common_shingles(asks: list[np.ndarray], there: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of the one list with each of the other, exactly: products of incidence matrices, some shingles at a time."""
    sets = [*asks, *there]
    size = np.array([len(v) for v in sets])
    ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(sets)), size)
    shared = counts > 1
    several = shared[ids]
    number = np.cumsum(shared) - 1
    ids, owner = number[ids[several]], owner[several]
    by = np.argsort(ids, kind="stable")
    ids, owner = ids[by], owner[by]
    out = np.zeros((len(asks), len(there)), np.float32)
    for lo in range(0, int(shared.sum()), SLICE):
        part = slice(*np.searchsorted(ids, (lo, lo + SLICE)))
        held = np.zeros((len(sets), SLICE), np.float32)
        held[owner[part], ids[part] - lo] = 1
        out += held[: len(asks)] @ held[len(asks) :].T
    return out.astype(np.int64)


def forest(linked: np.ndarray, asks: np.ndarray, there: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of components that ``linked`` joins, without those that others imply; asks and there name the components of its rows and columns."""
    label, out = {c: c for c in {*asks.tolist(), *there.tolist()}}, []

    def root(c):
        while label[c] != c:
            label[c] = c = label[label[c]]
        return c

    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        for c in np.unique(there[linked[i]]).tolist():
            a, b = root(int(asks[i])), root(c)
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((int(asks[i]), c))
    return out


def _once(blocks: DataFrame) -> DataFrame:
    """blocks (band, mb, qb, cls, comp, asks) without those that hold the same as another one: near copies meet in many bands, and their sets are sent for each block. A block has a bounded number of members."""
    members = F.sort_array(F.collect_list(F.struct("cls", "comp", "asks")))
    each = blocks.groupBy("band", "mb", "qb").agg(members.alias("members"))
    one = each.groupBy("members").agg(F.min(F.struct("band", "mb", "qb")).alias("of"))
    return one.select("of.*", F.inline("members"))


def _compare(dealt: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that some similar pair of a block links. dealt: (band, mb, qb, cls, comp, asks) of blocks."""

    def candidates():
        def f(g):
            asks = np.flatnonzero(g["asks"])
            there = np.flatnonzero(g["asks"] == 0)
            near = np.zeros((len(asks), len(there)), bool)
            if len(asks) and len(there):
                sketch, n, comp = np.array(g["sketch"], np.int64).view(np.uint64), g["n"], g["comp"]
                for at in range(0, len(asks), 32):
                    i = asks[at : at + 32]
                    z = np.bitwise_count(sketch[i][:, None] ^ sketch[there][None]).sum(axis=2)
                    small, large = np.minimum(n[i][:, None], n[there][None]), np.maximum(n[i][:, None], n[there][None])
                    near[at : at + 32] = (z <= FAR) & (100 * small >= percent * large) & (comp[i][:, None] != comp[there][None])
            take = [*asks[near.any(axis=1)], *there[near.any(axis=0)]]
            return [(int(g["band"][i]), int(g["mb"][i]), int(g["qb"][i]), int(g["cls"][i]), int(g["comp"][i]), int(g["asks"][i])) for i in take]

        return f

    def confirmed():
        def f(g):
            asks, there = np.flatnonzero(g["asks"]), np.flatnonzero(g["asks"] == 0)
            if not len(asks) or not len(there):
                return []
            x, y = ([np.frombuffer(g["shingles"][i], np.uint64) for i in k] for k in (asks, there))
            n, m = (np.array([len(v) for v in k]) for k in (x, y))
            both, comp = common_shingles(x, y), g["comp"]
            linked = (100 * both >= percent * (n[:, None] + m[None] - both)) & (comp[asks][:, None] != comp[there][None])
            return forest(linked, comp[asks], comp[there])

        return f

    keys, block = ["band", "mb", "qb"], "band bigint, mb int, qb int, cls bigint, comp bigint, asks int"
    left = freeze(map_groups(dealt.join(classes.select("cls", "n", "sketch"), "cls"), keys, candidates, block), "candidates")
    return map_groups(_once(left).join(sets, "cls"), keys, confirmed, "a bigint, b bigint").distinct()


def _blocks(size: str, weight: str) -> Column:
    """How many blocks a bucket of so many members and shingles is cut into."""
    return F.ceil(F.greatest(F.col(size) / BLOCK, F.col(weight) / BLOCK_SHINGLES)).cast("int")


def _deal(n: Column) -> Column:
    return F.pmod(F.xxhash64("cls"), n).cast("int")


def _hub_blocks(comp: DataFrame) -> DataFrame | None:
    """Blocks of step 2: of each bucket of several blocks, the first one is held against the classes for which it is the largest bucket. None without such buckets."""
    sizes = comp.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).withColumn("m", _blocks("size", "weight")).where(F.col("m") > 1)
    rows = freeze(comp.join(sizes, "band"), "large_buckets")
    if rows.isEmpty():
        return None
    largest = rows.groupBy("cls").agg(F.max(F.struct("size", "band")).alias("of"))
    own = rows.join(largest, "cls").where(F.col("band") == F.col("of.band"))
    blocks = own.groupBy("band", _deal(F.col("m")).alias("mb")).agg(F.lit(0).alias("qb"))
    there = own.select("band", _deal(F.col("m")).alias("mb"), F.lit(0).alias("qb"), "cls", "comp", F.lit(0).alias("asks"))
    hubs = rows.where(_deal(F.col("m")) == 0).select("band", "cls", "comp").join(blocks, "band").select("band", "mb", "qb", "cls", "comp", F.lit(1).alias("asks"))
    return there.unionAll(hubs)


def _whole_blocks(comp: DataFrame) -> DataFrame:
    """Blocks of step 3: members outside the largest component against all members."""
    parts = comp.groupBy("band", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    most = F.max(F.struct("size", "comp", "weight"))
    buckets = parts.groupBy("band").agg(most.alias("most"), F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    buckets = buckets.withColumn("m", _blocks("size", "weight")).withColumns({"size": F.col("size") - F.col("most.size"), "weight": F.col("weight") - F.col("most.weight")})
    rows = comp.join(buckets.select("band", "m", F.col("most.comp").alias("largest"), _blocks("size", "weight").alias("q")), "band")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = rows.select("band", _deal(F.col("m")).alias("mb"), each("q").alias("qb"), "cls", "comp", F.lit(0).alias("asks"))
    asks = rows.where(F.col("comp") != F.col("largest")).select("band", each("m").alias("mb"), _deal(F.col("q")).alias("qb"), "cls", "comp", F.lit(1).alias("asks"))
    return there.unionAll(asks)


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) for every end of an edge: smallest class reachable. Minimum over neighbours, then over the label's label, until nothing changes."""
    both = freeze(edges.unionAll(edges.select("b", "a")).distinct(), "links")
    labels = freeze(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "cls"), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"cls": "b"}), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        up = labels.join(near, "cls").select("cls", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("cls").alias("next"), F.col("comp").alias("far"))
        moved = freeze(up.join(jump, "next", "left").select("cls", F.least("next", F.coalesce("far", "next")).alias("comp"), F.col("comp").alias("was")), "labels")
        labels = moved.select("cls", "comp")
        if moved.where(F.col("comp") != F.col("was")).isEmpty():
            return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (cls, comp) after links between their components, or between classes without one."""
    more = components(links)
    up = labels.join(more.select(F.col("cls").alias("comp"), F.col("comp").alias("up")), "comp", "left")
    alone = more.join(labels, "cls", "left_anti")
    return freeze(up.select("cls", F.coalesce("up", "comp").alias("comp")).unionAll(alone.select("cls", "comp")), "labels")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, keep: list[str] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, first) and other columns named in keep for each row of docs (doc_id, text): ``kept`` rows have their component's smallest id, one row of each is ``first``."""
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 and more")
    wanted, keep = keep, [c for c in keep if c not in ("doc_id", "text")]

    def make():
        shingles = shingler(shingle)

        def row(r):
            found = shingles(r[0])
            if not len(found):
                return 0, None, None, None, None
            s = samples(found)
            return len(found), *set_digest(found), band_keys(s), odd_sketch(s)

        return row

    held = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    schema = fields(held, held.columns) + "n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>"
    signed = freeze(map_rows(held, make, schema, kept=len(held.columns), reads=["text"]), "minhash")
    known = signed.where(F.col("set_a").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
    equal = known.groupBy("set_a", "set_b").agg(first.alias("first"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in ("sketch", "bands")))
    classes = freeze(equal.withColumn("cls", F.monotonically_increasing_id()), "classes")

    # counted and joined by one shuffle of the bands, so both read the same columns
    rows = classes.select("cls", "n", F.explode("bands").alias("band")).repartition("band")
    one = F.struct("cls", "n")
    hubs = F.array(F.min(one), F.max(one), F.min_by(one, F.xxhash64("cls")))
    stars = rows.groupBy("band").agg(hubs.alias("hubs")).where(F.col("hubs")[0]["cls"] < F.col("hubs")[1]["cls"])
    members = freeze(rows.join(stars, "band"), "buckets")  # (band, cls, n, hubs) of buckets with two classes at least

    fits = lambda n_a, n_b: 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("sketch").alias(f"s_{c}"))
    near = members.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.explode("hubs").alias("hub")).select("a", "n_a", F.col("hub.cls").alias("b"), F.col("hub.n").alias("n_b"))
    near = near.where((F.col("a") != F.col("b")) & fits("n_a", "n_b")).select("a", "b").distinct()
    near = near.join(side("a"), "a").join(side("b"), "b").withColumn("estimate", _estimate("s_a", "s_b"))
    best = freeze(near.where(F.col("estimate") >= ESTIMATE).groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b")), "hubs")
    sets = _sets(signed, classes, members.select("cls"), shingle)
    labels = components(_verify(best, sets, percent))

    for blocks in (_hub_blocks, _whole_blocks):
        comp = members.select("band", "cls", "n").join(labels, "cls", "left").select("band", "cls", "n", F.coalesce("comp", "cls").alias("comp"))
        mixed = comp.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") < F.col("hi"))
        dealt = blocks(freeze(comp.join(mixed.select("band"), "band"), "mixed_buckets"))
        if dealt is not None:
            labels = _joined(labels, _compare(dealt, classes, sets, percent))

    named = classes.select("set_a", "set_b", "cls", "first").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = named.groupBy("comp").agg(F.min("first").alias("smallest"))
    by_set = named.join(smallest, "comp").select("set_a", "set_b", "smallest")
    out = signed.drop("bands", "sketch").join(by_set, ["set_a", "set_b"], "left")
    alone = F.col("set_a").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("smallest.doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    rest = ["text"] * ("text" in wanted) + [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), (alone | (F.col("row") == F.col("smallest.row"))).alias("first"), *rest)
