"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words (lower-cased, without punctuation), the shapes
of its words (runs of capitals, letters and digits collapsed, punctuation kept),
words that repeat one, two or three places later, and repeated lines; a term's
weight is the square root of its share, scaled by one less its entropy over the
labelled documents. The labelled documents' term matrix is factored by its Gram
matrix, and DIMENSIONS latent directions are kept. Their unit vectors are
broadcast; every document is folded in, compared with all of them by one matrix
product a block, and scored by the NEIGHBOURS closest ones' labels, weighted by
cosine and by how many labelled documents a sampled one of its label stands for.

What is learnt is bounded by parameters: at most ``per_class`` labelled rows of
each label, in hash order of doc_id, and the VOCABULARY terms that most of them
have. Scoring reads every whole text, one map without a shuffle.

Defined results: null and empty texts, and texts without a known term, get the
share of label 1 among the labelled rows; neighbours at the last one's cosine
all vote; several labels of one id: 1 if any is; of several texts of one id the
one of the smallest digest teaches; labels that are null or without a document
teach nothing; without any label every score is 0.5, with one kind its label;
ids may be null or repeat; label, language and source columns are never read by
a score; columns not named in ``keep`` are ignored; an empty table has no rows.
"""

import re
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, fields, map_rows, trim, utf8, with_text

PER_CLASS, VOCABULARY, MIN_DOCS, DIMENSIONS, NEIGHBOURS, PRIOR = 1000, 2048, 4, 48, 9, 1e-3
STEPS = (1, 2, 3)
_RUN = re.compile(r"(.)\1+")
_TRIM = ".,;:!?|#$%&*()[]{}<>\"'"


def _names(word: str) -> tuple[str, str]:
    """The terms of a word: its shape and itself."""
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return "s" + _RUN.sub(r"\1+", shape), "w" + word.lower().strip(_TRIM)


class Names(dict):
    """Terms of words met so far; bounded, as words are not."""

    def __missing__(self, word):
        found = _names(word)
        if len(self) < 1 << 17 and len(word) < 64:
            self[word] = found
        return found


def terms(text: str, names: Names) -> dict[str, float]:
    """Shares of a text's terms."""
    words = text.split()
    out: dict[str, float] = {}
    if not words:
        return out
    for word, count in Counter(words).items():
        for term in names[word]:
            out[term] = out.get(term, 0.0) + count / len(words)
    for step in STEPS:
        if again := sum(map(eq, words, words[step:])):
            out[f"again {step}"] = again / len(words)
    lines = text.split("\n")
    if (kinds := len(set(lines))) < len(lines):
        out["line again"] = 1 - kinds / len(lines)
    return out


def training_terms(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int) -> tuple[DataFrame, dict]:
    """(doc_id, label, stands_for, term, share) of sampled labelled documents, and the count of labelled rows by label."""
    known = labels.where(F.col("quality").isNotNull() & learn).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = None
    for label, n in sorted(counts.items()):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = some.withColumn("stands_for", F.lit(n / min(n, per_class)))
        sample = some if sample is None else sample.unionAll(some)
    if sample is None:
        return None, counts
    # at most 2 * per_class narrow rows, so the sample is broadcast
    rows = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "label", "stands_for").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))

    def make():
        names = Names()

        def row(r):
            found = terms(r[-1].decode(errors="replace"), names)
            return (*r[:-1], list(found), list(found.values()))

        return row

    wide = map_rows(rows, make, fields(rows, ["doc_id", "label", "stands_for"]) + "terms array<string>, shares array<double>")
    pair = F.explode(F.arrays_zip("terms", "shares")).alias("t")
    return wide.select("doc_id", "label", "stands_for", pair).select("doc_id", "label", "stands_for", F.col("t.terms").alias("term"), F.col("t.shares").alias("share")), counts


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, vocabulary: int = VOCABULARY) -> dict:
    """The model: term numbers, projection, the labelled rows' unit vectors, labels and weights, and the prior."""
    spread, counts = training_terms(docs, labels, learn, per_class)
    total = sum(counts.values())
    model = {"terms": {}, "prior": counts.get(1, 0) / total if total else 0.5}
    if spread is None:
        return model
    # the vocabulary is chosen in Spark; the driver gets per_class * 2 rows of at most `vocabulary` numbers
    shared = spread.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    chosen = [r["term"] for r in shared.orderBy(F.desc("n"), "term").limit(vocabulary).collect()]
    number = spread.sparkSession.createDataFrame(list(enumerate(chosen)), "number int, term string")
    of_doc = F.array_sort(F.collect_list(F.struct("number", "share"))).alias("found")
    kept = spread.join(F.broadcast(number), "term").groupBy("doc_id", "label", "stands_for").agg(of_doc)
    rows = kept.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not rows:
        return model
    matrix = np.zeros((len(rows), len(chosen)))
    for row, r in zip(matrix, rows):
        row[[x["number"] for x in r["found"]]] = np.sqrt([x["share"] for x in r["found"]])
    share = matrix / matrix.sum(0).clip(min=1e-12)
    entropy = -(share * np.log(share.clip(min=1e-12))).sum(0) / np.log(max(2, len(rows)))
    weight = (1 - entropy).clip(min=0.05)
    value, vector = np.linalg.eigh((matrix * weight).T @ (matrix * weight))
    base = vector[:, ::-1][:, :DIMENSIONS] * weight[:, None]
    base = base[:, value[::-1][: base.shape[1]] > 1e-9]
    known = _unit(matrix @ base)
    stands = np.array([r["stands_for"] for r in rows])
    return model | {"terms": {t: i for i, t in enumerate(chosen)}, "base": base, "known": known, "label": np.array([r["label"] for r in rows], float), "weight": stands}


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True).clip(min=1e-12)


def vote(vectors: np.ndarray, model: dict) -> np.ndarray:
    """Share of label 1 among the closest labelled rows of each unit vector, weighted by cosine; the prior counts as PRIOR of a row."""
    cosine = np.round(vectors @ model["known"].T, 6).clip(min=0)
    k = min(NEIGHBOURS, cosine.shape[1])
    last = np.partition(cosine, -k, axis=1)[:, -k]
    votes = np.where(cosine >= last[:, None], cosine, 0) * model["weight"]
    return (votes @ model["label"] + PRIOR * model["prior"]) / (votes.sum(1) + PRIOR)


def score(docs: DataFrame, model: dict, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep + (score): the weighted vote of each text's neighbours."""
    import pyarrow as pa

    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows, text = with_text(docs, keep)
    bounded_batches(docs.sparkSession)
    schema = fields(docs, keep) + "score double"
    out_names = [*keep, "score"]

    def run(batches):
        model, names = sent.value, Names()
        number = model["terms"]
        for batch in batches:
            score = np.full(batch.num_rows, model["prior"])
            if number:
                dense = np.zeros((batch.num_rows, len(number)))
                raw = batch.column(text[0]).cast(pa.binary()).fill_null(b"")
                for at, value in enumerate(raw):
                    for term, share in terms(value.as_py().decode(errors="replace"), names).items():
                        if (n := number.get(term)) is not None:
                            dense[at, n] = share
                vectors = _unit(np.sqrt(dense) @ model["base"])
                score = np.where(dense.any(1), vote(vectors, model), score)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=out_names)
        trim()

    return rows.mapInArrow(run, schema)
