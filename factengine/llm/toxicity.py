"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A sentence's score is a logistic function of the weights of its words and their
beginnings; a document's is
1 - prod(1 - sentence score). Training maximises the likelihood of document
labels by Adam in numpy. It reads a bounded sample of labelled rows, at most
``per_class`` of each label in hash order of doc_id (default PER_CLASS), with
their words and word beginnings hashed to BUCKETS; only buckets seen in MIN_DOCS
sampled documents whose shares of the two labels differ by MIN_Z standard errors
get a weight, so the model is bounded too. Scoring reads every whole text, one
map without a shuffle.

Defined results: null and empty texts have no sentence and score 0; several
labels of one id: toxic if any is; labels that are null or without a document
teach nothing; without labels of both kinds, or words that tell them apart, every score is 0; ids may be null or
repeat; label, language and source columns are never read by a score.
"""

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import fields, map_rows, utf8, with_text

PER_CLASS, BUCKETS, MIN_DOCS, MIN_Z, STEPS, RATE, DECAY = 1500, 1 << 20, 4, 4.0, 200, 0.1, 1e-3
STEMS = range(4, 10)
PIECE = 1 << 20
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or b == 39 else 10 if b in b".!?\n" else 32 for b in range(256))
_MARK = re.compile(rb"[^.!?\n]+[.!?]*")


def sentences(text: bytes):
    """Word lists of the sentences that have words, with A-Z lower-cased."""
    at = 0
    while at < len(text):
        cut = text.find(b"\n", at + PIECE) if len(text) - at > PIECE else -1
        end = cut + 1 or len(text)
        for s in text[at:end].translate(_WORD).split(b"\n"):
            if words := s.split():
                yield words
        at = end


def _features(word: bytes) -> list[int]:
    """Buckets of a word and of its beginnings of 4 to 9 bytes."""
    return [zlib.crc32(word[:k] + b"*" if k else word) % BUCKETS for k in (0, *STEMS) if k <= len(word)]


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int) -> DataFrame:
    """(toxic, tokens, sizes): hashed words of sampled labelled documents, sentence by sentence."""
    known = labels.where(F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sample = None
    for toxic in (True, False):
        some = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = some if sample is None else sample.unionAll(some)
    # at most 2 * per_class narrow rows, so the sample is broadcast
    rows = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def make():
        def row(r):
            parts = list(sentences(r[1]))
            found = [[x for w in p for x in _features(w)] for p in parts]
            return r[0], [x for f in found for x in f], [len(f) for f in found]

        return row

    return map_rows(rows.select("toxic", "text"), make, "toxic boolean, tokens array<int>, sizes array<int>")


def fit(rows) -> dict:
    """{'weights': {bucket: weight}, 'bias': b} from an Arrow table of training_rows."""
    label = np.array(rows["toxic"].to_pylist(), bool)
    if not label.any() or label.all():
        return {"weights": {}, "bias": None}
    tokens = rows["tokens"].combine_chunks().flatten().to_numpy()
    sizes = rows["sizes"].combine_chunks().flatten().to_numpy()
    n_sent = rows["sizes"].combine_chunks().value_lengths().to_numpy()
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.repeat(np.arange(len(n_sent)), n_sent)
    pairs = np.unique(tokens.astype(np.int64) * len(label) + doc[sentence])
    found, start, seen = np.unique(pairs // len(label), return_index=True, return_counts=True)
    toxic = np.add.reduceat(label[pairs % len(label)].astype(np.int64), start)
    share, rate = toxic / label.sum(), seen / len(label)
    z = (share - (seen - toxic) / (~label).sum()) / np.sqrt(rate * (1 - rate).clip(min=1e-3) * len(label) / (label.sum() * (~label).sum()))
    found = found[(seen >= MIN_DOCS) & (np.abs(z) >= MIN_Z)]
    if not len(found):
        return {"weights": {}, "bias": None}
    at = np.searchsorted(found, tokens).clip(max=len(found) - 1)
    used = found[at] == tokens
    at, sentence = at[used], sentence[used]
    weight, bias = np.zeros(len(found)), -4.0
    m, v, mb, vb = np.zeros(len(found)), np.zeros(len(found)), 0.0, 0.0
    balance = np.where(label, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / len(label)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(sentence, weight[at], len(sizes)))))
        clean = np.bincount(doc, np.log1p(-p.clip(max=1 - 1e-9)), len(label))  # log of prod(1 - p)
        # d loss / d logit of a sentence: p for a clean document, -p * clean / (1 - clean) for a toxic one
        pull = np.where(label, -np.exp(clean) / (-np.expm1(clean)).clip(min=1e-6), 1.0) * balance
        g = p * pull[doc]
        gw = np.bincount(at, g[sentence], len(found)) + DECAY * weight / len(found)
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        scale = RATE / (1 - 0.9**step)
        weight = weight - scale * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        bias = min(bias - scale * mb / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6), -2.0)
    return {"weights": dict(zip(found.tolist(), weight.tolist())), "bias": float(bias)}


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> dict:
    return fit(training_rows(docs, labels, learn, per_class).toArrow())


def score(docs: DataFrame, model: dict, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep + (score, worst, worst_score): noisy-or over sentences, and where the most offending sentence stands, as characters [start, end)."""
    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        weights, bias = sent.value["weights"], sent.value["bias"]

        class Weight(dict):  # a word's weight, looked up by its hash once
            def __missing__(self, word):
                w = sum(weights.get(x, 0.0) for x in _features(word))
                if len(self) < 1 << 18:
                    self[word] = w
                return w

        weight = Weight().__getitem__

        def row(r):
            clean, best, best_at = 0.0, -np.inf, -1
            if bias is not None:
                sums = [sum(map(weight, words)) for words in sentences(r[-1])]
                if sums:
                    logits = bias + np.array(sums)
                    clean = float(-np.logaddexp(0, logits).sum())
                    best_at = int(logits.argmax())
                    best = float(logits[best_at])
            span = locate(r[-1], best_at) if best > 0 else None
            return float(-np.expm1(clean)), span, float(1 / (1 + np.exp(-best)))

        return row

    sent_rows, text = with_text(docs, keep)
    return map_rows(sent_rows, make, fields(docs, keep) + "score double, worst struct<start:bigint,end:bigint>, worst_score double", kept=len(keep), reads=text)


def locate(text: bytes, sentence: int) -> dict | None:
    """Character offsets of the n-th sentence that has words."""
    n = -1
    for m in _MARK.finditer(text):
        n += bool(m.group().translate(_WORD).split())
        if n == sentence:
            start = len(text[: m.start()].decode(errors="ignore"))
            return {"start": start, "end": start + len(m.group().decode(errors="ignore"))}
    return None
