"""Quality votes, vector codes and fill-in-middle against plain versions, and rows of every odd kind."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from factengine.llm import fim, pq as codes, quality
from factengine.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, n string, form int, output string, score string, __v int"
VECTORS = "vec_id bigint, embedding array<float>, label int, code int, error string, __label int, text string"


@pytest.fixture(scope="module")
def docs():
    return [tuple(r.values()) for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def odd_docs(spark, texts):
    return spark.createDataFrame([(i, t, None, 1, "o", None, 2) for i, t in texts], DOCS)


# 13


def test_skip_list_finds_every_rank():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 17, 64, 257, 1000):
        text = "".join(rng.choice(["ab", "Z", " ", "é", "\U0001f600", "1", "\n"]) for _ in range(n))
        widths = fim.unit_widths(text)
        lanes = fim.SkipList(widths)
        units = brute.re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert widths.tolist() == [len(u) for u in units]
        assert [lanes.offset(r) for r in range(len(units) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]
    assert len(lanes.lanes) > 3


def test_skip_list_takes_few_steps():
    class Counted(list):
        def __getitem__(self, i):
            steps[0] += 1
            return super().__getitem__(i)

    lanes = fim.SkipList(np.ones(1 << 18, np.int32))
    lanes.lanes = [(Counted(u.tolist()), p, b) for u, p, b in lanes.lanes]
    worst = 0
    for rank in range(0, 1 << 18, 9973):
        steps = [0]
        assert lanes.offset(rank) == rank
        worst = max(worst, steps[0])
    assert worst < 400


def test_fill_in_middle_odd(spark):
    long = "word, " * 200_000
    texts = [(i, t) for i, t in enumerate(["<P>", "a<S", "<", "P>", "x <M> y", "", None, " \n\t ", long, "é" * 300, "A", "1", "<P<S<M", "a b c d e f g"] * 7)]
    texts += [(3, "one two"), (3, "one two"), (3, "other text"), (None, "no id here"), (None, None)]
    df = odd_docs(spark, texts)
    made = fim.fill_in_middle(df, keep=["doc_id", "text"]).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    got = made.collect()
    assert all(r.back == (r.text or "") for r in got)
    key = lambda r: tuple(map(str, r))
    assert Counter(key((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == Counter(key((i, *brute.fill_in_middle(i, t))) for i, t in texts)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_fill_in_middle_other_shares(spark):
    df = odd_docs(spark, [(i, "some words to cut") for i in range(200)])
    forms = lambda **k: {r.form for r in fim.fill_in_middle(df, **k).collect()}
    assert forms(fim_percent=0) == {"plain"}
    assert forms(fim_percent=100, spm_percent=100) == {"spm"}
    assert forms(fim_percent=100, spm_percent=0) == {"psm"}
    assert len({r.output for r in fim.fill_in_middle(df, seed=F.lit("same"), fim_percent=100).collect()}) == 1


def test_fill_in_middle_whole_table(spark, sf_dir, docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, t in docs:
        n, form, p, m, out = brute.fill_in_middle(i, t)
        want[i] = (n, form, p, m, sha(out), sha(t or ""))
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op13_fill_in_middle"](spark, sf_dir).collect()} == want


# 12


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "e", 1, None) for i, v, label in rows], VECTORS)


def coded(spark, rows, **options):
    found, books = codes.compress(vectors(spark, rows), **options)
    return sorted(map(str, map(tuple, found.select("vec_id", "label", "code", "error").collect()))), books.tolist()


@pytest.mark.parametrize("n, block, entries", [(700, 64, 16), (40, 4096, 256), (300, 7, 256)])
def test_vector_codes(spark, monkeypatch, n, block, entries):
    monkeypatch.setattr(codes, "BLOCK", block)
    rng = np.random.default_rng(n)
    rows = [(int(i), np.float32(rng.normal(0, 0.2, 8)).tolist(), int(i % 3)) for i in rng.permutation(n)]
    rows += [(r[0] + 5000, rows[0][1], 1) for r in rows[:n]]  # half of the rows are one vector
    want, books = brute.vector_codes(rows, entries=entries)
    got, got_books = coded(spark, rows, entries=entries)
    assert got == sorted(map(str, want)) and got_books == books


def test_vector_codes_odd(spark):
    nan, inf = float("nan"), float("inf")
    ok = [0.5, -0.25, 1.0, -1.0, 0.0, 2.0, -0.0001, 3.0]
    rows = [(5, ok, None), (5, ok, None), (5, [x + 1 for x in ok], 2), (None, [x - 1 for x in ok], 2), (1, None, 1), (2, [], 1), (3, [*ok[:7], None], 1), (4, [*ok[:7], nan], 1), (6, [inf, *ok[1:]], 1), (7, [-inf, *ok[1:]], 1)]
    rows += [(8, ok[:4], 1), (9, ok[:5], 1), (10, [1e30] * 8, 1), (11, [90000.0] * 8, 3), (12, [-90000.0] * 8, 3), (13, [0.0] * 8, None)]
    want, books = brute.vector_codes([r for r in rows if r[0] != 10])
    got, got_books = coded(spark, rows)
    assert got == sorted(map(str, want)) and got_books == books
    totals = codes.label_errors(codes.compress(vectors(spark, rows), entries=2)[0])
    by_label = {}
    for r in totals.collect():
        by_label.setdefault(r.label, []).append(r)
    assert set(by_label) == {None, 2, 3} and sum(map(len, by_label.values())) == len(want)
    assert all(r.label_error == sum(x.error for x in found) for found in by_label.values() for r in found)
    empty = vectors(spark, rows).where("false")
    for df in (empty, vectors(spark, [(1, None, 1), (2, [nan] * 4, 1)])):
        found, books = codes.compress(df)
        assert found.count() == 0 and books.size == 0 and codes.label_errors(found).collect() == []


def test_distances_by_dictionaries():
    rng = np.random.default_rng(1)
    for scale in (100, 10**7):  # sums in 32 and in 64 bits
        part, book = rng.integers(-scale, scale, (200, 5)), rng.integers(-scale, scale, (31, 5))
        made = [np.unique(part[:, d], return_inverse=True) for d in range(5)]
        entry, distance = codes.nearest([v.tolist() for v, _ in made], np.array([c for _, c in made]), book)
        exact = ((part[:, None] - book[None]) ** 2).sum(2)
        assert (entry == exact.argmin(1)).all() and (distance == exact.min(1)).all()


# 11


def test_quality_whole_table(spark, sf_dir, docs):
    labels = [(r["doc_id"], r["quality"]) for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()]
    want = brute.quality_scores(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op11_quality"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    assert max(abs(got[i].score - want[i]) for i in want) < 1e-4
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    held = [r for r in QUERIES["op11_quality"](spark, folder).where("held_out").collect() if r.doc_id in truth]
    assert len(held) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted for r in held if truth[r.doc_id] == 1)


def test_quality_odd(spark):
    good, bad = "plain words that follow one another in a line.", "BAD!! BAD!! WORDS!! WORDS!! || ## ##"
    texts = [(i, f"{good} number{i}" if i % 3 else f"{bad} {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x") for i in range(60)] + [(7, 1, 1, "x"), (8, None, 1, "x"), (999, 0, 0, "x"), (None, 0, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    odd = [(100, None), (101, ""), (102, " \n "), (103, "lorem ipsum " * 200_000), (None, good), (None, bad), (5, bad), (104, "\U0001f600"), (105, good), (105, good)]
    df = odd_docs(spark, texts + odd)
    model = quality.train(df, labels, F.lit(True))
    got = quality.score(df, model, keep=["doc_id", "text"]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(texts + odd)
    assert all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())  # equal texts, equal scores
    assert by_text[None] == by_text[""] == by_text[" \n "] == {model["prior"]}
    assert min(by_text[good]) > 0.9 and max(by_text[bad]) < 0.1
    assert quality.score(df.limit(0), model).collect() == []
    none = quality.train(df, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    one = quality.train(df, labels.where("quality = 1"), F.lit(True))
    assert all(r.score > 0.99 for r in quality.score(df, one).collect())
    assert quality.score(df, quality.train(df.limit(0), labels, F.lit(True))).count() == len(texts + odd)


def test_quality_learns_from_a_bounded_sample(spark):
    df = odd_docs(spark, [(i, f"good words here {i}" if i % 2 else f"BAD!! || {i}") for i in range(80)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, quality int")
    model = quality.train(df, labels, F.lit(True), per_class=10, vocabulary=5)
    assert len(model["known"]) == 20 and len(model["terms"]) <= 5 and set(model["weight"]) == {4.0}
    assert sum((r.score >= 0.5) == r.doc_id % 2 for r in quality.score(df, model).collect()) == 80
