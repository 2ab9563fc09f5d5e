"""Log-bilinear language model trained in numpy by noise-contrastive estimation.

Tokens are whitespace words with A-Z lower-cased and one end per text. A token
belongs to a class: the most frequent words and the end are classes of their own,
other words fall by their last bytes; the number of both kinds of classes grows
with the square root of the counted vocabulary. The model predicts the class from
the classes of two tokens before (log-bilinear: position matrices times context
embeddings, dot a class embedding, plus a bias), times the token's smoothed share
of its class, so probabilities sum to one over the known words and the unknown
ones of each class.

Counts come from all learning texts: word counts by the distinct-word shuffle,
class trigrams packed per shard, where a hash deals texts to shards of about
SHARD_TOKENS tokens, whatever the partitions. Training reads all of them, and
they stay in Spark: in each round every shard descends from the same parameters
in minibatches over its part of the round, and the results are averaged by tokens.
Noise is the class unigram.

Defined results: null and empty texts have one token, the end; without learning
texts all counts are 0; repeated rows give repeated rows; ids may be null or repeat.
"""

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .chunks import DOC, WORDS, answer, pack_ints, reassemble, unpack_ints, unpack_words, word_chunks
from .common import ASCII_LOWER, fields, freeze

CLASSES, START = 128, 127  #: the least number of classes, and its last class
DIM, NOISE, SAMPLES, RATE, SEED = 24, 25, 64, 0.02, 7
ROUNDS, BATCH, LEAST_STEPS, PIECE_COUNT, SHARD_TOKENS, SCORED, MERGED = 4, 4096, 32, 8, 1 << 21, 1 << 19, 32
PIECE = 4 << 20


def split_words():
    def words(text):
        at = 0
        while at < len(text):  # long texts in pieces, cut at a blank
            end = min(len(text), at + PIECE)
            while end < len(text) and text[end] != 32 and not 9 <= text[end] <= 13:
                end += 1
            yield text[at:end].translate(ASCII_LOWER).split()
            at = end

    return words


@dataclass(frozen=True)
class Classes:
    """Classes by last bytes, then the most frequent words, the end and the start."""

    tail: int
    top: dict[bytes, int]

    @property
    def end(self) -> int:
        return self.tail + len(self.top)

    @property
    def start(self) -> int:
        return self.end + 1

    def __len__(self) -> int:
        return self.end + 2

    def of(self, word: bytes) -> int:
        found = self.top.get(word)
        return zlib.crc32(word[-3:]) % self.tail if found is None else found


def class_sizes(kinds: int) -> tuple[int, int]:
    """Classes by last bytes and of single words for so many distinct words."""
    return max(64, math.isqrt(kinds) // 8), max(62, math.isqrt(kinds) // 4)


def _counter():
    """Global counts of a bucket's words; with them (chunk null) the bucket's vocabulary with its counts."""

    def make():
        def f(messages):
            messages, total = list(messages), {}
            for _, words, counts in messages:
                for w, c in zip(unpack_words(words), unpack_ints(counts).tolist()):
                    total[w] = total.get(w, 0) + c
            for chunk, words, _ in messages:
                yield chunk, pack_ints(np.array([total[w] for w in unpack_words(words)], np.uint64)), None, None
            known = [(w, c) for w, c in total.items() if c]
            yield None, None, [w for w, _ in known], [c for _, c in known]

        return f

    return make, "known array<binary>, known_counts array<bigint>"


def _slot_classes(word_rows: list[dict], classes: Classes) -> np.ndarray:
    slots = [unpack_ints(w["slots"]) for w in word_rows]
    out = np.zeros(sum(map(len, slots)), np.int32)
    for s, w in zip(slots, word_rows):
        out[s] = list(map(classes.of, unpack_words(w["words"])))
    return out


def _history(of: np.ndarray, start: int, n: int) -> np.ndarray:
    """For each token, its two predecessors as one number; texts start with two starts."""
    padded = np.concatenate([[start, start], of]).astype(np.int64)
    return padded[:-2] * n + padded[1:-1]


def _trigrams(chunks: DataFrame, classes: Classes, shards: int) -> DataFrame:
    """(shard, cells, counts, tokens): a row of packed class trigrams for each shard of the learning texts; each chunk adds up its own first."""

    def table(rows):
        columns = zip(*rows) if rows else [[]] * 4
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["shard", "cells", "counts", "tokens"])

    def packed(shard, cells, counts):
        return int(shard), pack_ints(np.diff(cells, prepend=0)), pack_ints(counts), int(counts.sum())

    def run(group: pa.Table) -> pa.Table:
        kind = np.array(group["kind"].to_pylist())
        of, found = _slot_classes(group.filter(pa.array(kind == WORDS)).to_pylist(), classes), {}
        for seq, learn in zip(group["seq"], group["learn"]):
            if learn.as_py():
                own = np.append(of[unpack_ints(seq.as_py())], np.int32(classes.end))
                cells = _history(own, classes.start, len(classes)) * len(classes) + own
                found.setdefault(zlib.crc32(own.tobytes()) % shards, []).append(cells)
        return table([packed(s, *np.unique(np.concatenate(c), return_counts=True)) for s, c in found.items()])

    def merge(group: pa.Table) -> pa.Table:
        cells = np.concatenate([np.cumsum(unpack_ints(c).astype(np.int64)) for c in group["cells"].to_pylist()])
        counts = np.concatenate([unpack_ints(c).astype(np.int64) for c in group["counts"].to_pylist()])
        cells, at = np.unique(cells, return_inverse=True)
        return table([packed(group["shard"][0].as_py(), cells, np.bincount(at, counts, len(cells)).astype(np.int64))])

    schema = "shard bigint, cells binary, counts binary, tokens bigint"
    parts = chunks.select("chunk", "kind", "learn", "seq", "words", "slots").groupBy("chunk").applyInArrow(run, schema)
    return freeze(parts.groupBy("shard").applyInArrow(merge, schema), "lm_trigrams")


def initial(noise: np.ndarray) -> dict[str, np.ndarray]:
    rng, n = np.random.default_rng(SEED), len(noise)
    m = {"context": rng.normal(0, 0.1, (n, DIM)), "far": np.eye(DIM) * 0.5, "near": np.eye(DIM), "target": rng.normal(0, 0.1, (n, DIM)), "bias": np.log(noise)}
    return {k: v.astype(np.float32) for k, v in m.items()}


def unigram(counts: np.ndarray) -> np.ndarray:
    noise = counts / max(counts.sum(), 1) + 1e-7
    return noise / noise.sum()


def descend(m: dict[str, np.ndarray], noise: np.ndarray, cells: np.ndarray, counts: np.ndarray, turn: int, seed: int) -> dict[str, np.ndarray]:
    """Parameters after a shard's part of round ``turn``: Adam on the NCE objective, in minibatches. The rounds' parts make up all counts."""
    n = len(noise)
    pieces = -(-counts // PIECE_COUNT)  # a frequent cell comes several times, each with a part of its count
    order = np.random.default_rng((SEED, seed)).permutation(np.repeat(np.arange(len(cells)), pieces))
    part = order[turn::ROUNDS] if len(order) >= ROUNDS else order
    if not len(part):
        return m
    rng = np.random.default_rng((SEED, seed, turn))
    weight = (counts / pieces).astype(np.float32)
    log_noise = np.log(NOISE * noise).astype(np.float32)
    cumulated = np.cumsum(noise)
    cumulated[-1] = 1
    steps = min(LEAST_STEPS, -(-LEAST_STEPS * BATCH // len(part)))
    m = dict(m)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step, rate = 0, np.float32(RATE / (1 + turn))
    for _ in range(max(1, steps)):
        for at in range(0, len(part), BATCH):
            pick = part[at : at + BATCH]
            w = weight[pick] / weight[pick].sum()
            context, target = np.divmod(cells[pick], n)
            far, near = np.divmod(context, n)
            false = np.searchsorted(cumulated, rng.random(SAMPLES))
            r_far, r_near, r_target, r_false = m["context"][far], m["context"][near], m["target"][target], m["target"][false]
            hidden = r_far @ m["far"] + r_near @ m["near"]
            good = np.einsum("ij,ij->i", hidden, r_target) + m["bias"][target] - log_noise[target]
            g_good = -w / (1 + np.exp(good.clip(-60, 60)))
            bad = hidden @ r_false.T + (m["bias"][false] - log_noise[false])
            g_bad = (w * np.float32(NOISE / SAMPLES))[:, None] / (1 + np.exp((-bad).clip(-60, 60)))
            g_hidden = g_good[:, None] * r_target + g_bad @ r_false
            grads = {"far": r_far.T @ g_hidden, "near": r_near.T @ g_hidden, "context": np.zeros_like(m["context"]), "target": np.zeros_like(m["target"]), "bias": np.bincount(target, g_good, n) + np.bincount(false, g_bad.sum(axis=0), n)}
            _add_rows(grads["context"], np.concatenate([far, near]), np.concatenate([g_hidden @ m["far"].T, g_hidden @ m["near"].T]))
            _add_rows(grads["target"], np.concatenate([target, false]), np.concatenate([g_good[:, None] * hidden, g_bad.T @ hidden]))
            step += 1
            for k, v in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * v.astype(np.float32)
                second[k] = 0.999 * second[k] + 0.001 * np.square(v, dtype=np.float32, casting="same_kind")
                m[k] = m[k] - rate * (first[k] / np.float32(1 - 0.9**step)) / (np.sqrt(second[k] / np.float32(1 - 0.999**step)) + np.float32(1e-9))
    return m


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    where, starts = np.unique(at[order], return_index=True)
    out[where] = np.add.reduceat(rows[order], starts, axis=0)


def train(cells: np.ndarray, counts: np.ndarray, classes: int = CLASSES) -> dict[str, np.ndarray]:
    """Model parameters from class trigram counts that fit one shard."""
    noise = unigram(np.bincount(cells % classes, counts, classes))
    m = initial(noise)
    for turn in range(ROUNDS):
        m = descend(m, noise, cells, counts, turn, 0)
    return m


def _flat(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in m.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([v.size for v in like.values()])[:-1]
    return {k: x.reshape(v.shape).astype(np.float32) for (k, v), x in zip(like.items(), np.split(flat, ends))}


def train_shards(shards: DataFrame, noise: np.ndarray) -> dict[str, np.ndarray]:
    """Model parameters from the packed trigrams of all shards: a job for each round; its averages meet in groups of MERGED shards before the driver."""
    m, context = initial(noise), shards.sparkSession.sparkContext
    for turn in range(ROUNDS):
        sent = context.broadcast((m, noise))

        def run(batches, turn=turn, sent=sent):
            m, noise = sent.value
            for batch in batches:
                for shard, cells, counts, tokens in zip(*(batch.column(c).to_pylist() for c in ("shard", "cells", "counts", "tokens"))):
                    cells = np.cumsum(unpack_ints(cells).astype(np.int64))
                    out = _flat(descend(m, noise, cells, unpack_ints(counts).astype(np.int64), turn, shard)).astype(np.float64) * tokens
                    yield pa.RecordBatch.from_pydict({"shard": [shard], "tokens": pa.array([tokens], pa.int64()), "sums": pa.array([out.tobytes()], pa.binary())})

        def merge(group: pa.Table) -> pa.Table:
            rows = sorted(zip(group["shard"].to_pylist(), group["tokens"].to_pylist(), group["sums"].to_pylist()))
            sums = sum(np.frombuffer(r[2]) for r in rows)
            return pa.table({"shard": [rows[0][0]], "tokens": pa.array([sum(r[1] for r in rows)], pa.int64()), "sums": pa.array([sums.tobytes()], pa.binary())})

        schema = "shard bigint, tokens bigint, sums binary"
        found = shards.mapInArrow(run, schema).groupBy(F.floor(F.col("shard") / MERGED)).applyInArrow(merge, schema).collect()
        total, tokens = 0, 0
        for r in sorted(found, key=lambda r: r.shard):
            total, tokens = total + np.frombuffer(r.sums), tokens + r.tokens
        m = _shaped(total / tokens, m) if tokens else m
        sent.unpersist()
    return m


def log10_chances(m: dict[str, np.ndarray], history: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each token's class after its history; the start, the last class, is never a token."""
    n = len(m["bias"])
    contexts, at = np.unique(history, return_inverse=True)
    far, near = np.divmod(contexts, n)
    hidden = (m["context"] @ m["far"])[far] + (m["context"] @ m["near"])[near]
    sums, own = np.empty(len(contexts), np.float32), np.empty(len(of), np.float32)
    target, bias = np.ascontiguousarray(m["target"][:-1].T), m["bias"][:-1]
    for i in range(0, len(contexts), 1024):
        score = hidden[i : i + 1024] @ target
        score += bias
        most = score.max(axis=1, keepdims=True)
        score -= most
        np.exp(score, out=score)
        sums[i : i + 1024] = np.log(score.sum(axis=1)) + most[:, 0]
    for i in range(0, len(of), 1 << 16):
        j = slice(i, i + (1 << 16))
        own[j] = np.einsum("ij,ij->i", hidden[at[j]], m["target"][of[j]]) + m["bias"][of[j]] - sums[at[j]]
    return own / np.float32(np.log(10))


def log10_table(m: dict[str, np.ndarray]) -> np.ndarray:
    """``log10_chances`` of every class for each pair of preceding classes."""
    n = len(m["bias"])
    out = np.full((n * n, n), -np.inf, np.float32)
    for pair in range(0, n * n, n):
        history = np.repeat(np.arange(pair, pair + n), n - 1)
        out[pair : pair + n, :-1] = log10_chances(m, history, np.tile(np.arange(n - 1), n)).reshape(n, n - 1)
    return out


def score(docs: DataFrame, learn: Column, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep + (learn, n_tokens, n_known, train_tokens, base_score, score), learning from rows where ``learn`` holds."""
    keep = list(keep)
    chunks = word_chunks(docs, keep, split_words, learn, "lm")
    counter, extra = _counter()
    answers = freeze(answer(chunks, counter, extra), "lm_counts")
    ends = chunks.where((F.col("kind") == DOC) & F.col("learn")).count()
    known = answers.where(F.col("chunk").isNull()).select(F.explode(F.arrays_zip("known", "known_counts")).alias("p")).select(F.col("p.known").alias("word"), F.col("p.known_counts").alias("n"))
    found = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = found[0] + ends, found[1] + (ends > 0)
    tail, own = class_sizes(found[1])
    best = known.orderBy(F.desc("n"), "word").limit(own).collect()
    classes = Classes(tail, {bytes(r.word): tail + i for i, r in enumerate(best)})
    sums, kinds = np.zeros(tail, np.int64), np.zeros(tail, np.int64)
    last = F.crc32(F.substring("word", -3, 3)) % tail
    for r in known.groupBy(last.alias("of")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        sums[r.of], kinds[r.of] = r.n, r.kinds
    for r in best:
        at = zlib.crc32(bytes(r.word)[-3:]) % tail
        sums[at] -= r.n
        kinds[at] -= 1
    noise = unigram(np.concatenate([sums, [r.n for r in best], [ends, 0]]))
    model = train_shards(_trigrams(chunks, classes, max(1, n // SHARD_TOKENS)), noise)
    sent = docs.sparkSession.sparkContext.broadcast((model, classes, n, v, ends, sums, kinds))

    def make():
        model, classes, n, v, ends, sums, kinds = sent.value
        share = np.zeros(len(classes))
        share[: classes.tail] = np.log10(sums + 0.1 * (kinds + 1))
        base_all = np.log10(n + 0.1 * (v + 1))
        base_end = np.log10(ends + 0.1) - base_all

        def f(docs, words, answers):
            of = _slot_classes(words, classes)
            count = np.zeros(len(of))
            for w in words:
                count[unpack_ints(w["slots"])] = unpack_ints(answers[w["bucket"]])
            logs = np.log10(count + 0.1)
            within = np.where(of < classes.tail, logs - share[of], 0.0)

            def scored(held):
                own = [np.append(of[seq], np.int32(classes.end)) for _, seq in held]
                history = [_history(x, classes.start, len(classes)) for x in own]
                chances = log10_chances(model, np.concatenate(history), np.concatenate(own))
                for (d, seq), chance in zip(held, np.split(chances, np.cumsum([len(x) for x in own])[:-1])):
                    base = float((logs[seq] - base_all).sum()) + base_end
                    p = float(chance.sum(dtype=np.float64) + within[seq].sum())
                    yield *(d[c] for c in keep), d["learn"], len(seq) + 1, int((count[seq] > 0).sum()) + (ends > 0), n, base, p

            held, size = [], 0
            for d in docs:
                held.append((d, unpack_ints(d["seq"])))
                size += len(held[-1][1]) + 1
                if size >= SCORED:
                    yield from scored(held)
                    held, size = [], 0
            if held:
                yield from scored(held)

        return f

    schema = fields(docs, keep) + "learn boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    rest = answers.where(F.col("chunk").isNotNull())
    return reassemble(chunks, rest, [*keep, "learn", "seq", "bucket", "words", "slots"], make, schema)
