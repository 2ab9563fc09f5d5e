"""The ten operators against plain versions, round trips, and rows of every odd kind."""

import hashlib
import json
import zlib

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from factengine.llm import bpe, chat, decontam, lm, media, neardup, suffix, toxicity, urls, warc
from factengine.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, n_words string, chunk int, score double"
LONG = "lorem ipsum dolor sit amet " * 60_000
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


@pytest.fixture(scope="module")
def docs():
    return [tuple(r.values()) for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and texts, columns with clashing names."""
    texts = [(1, SAME), (2, SAME), (2, SAME), (3, None), (4, ""), (5, " \n\t "), (None, SAME + " more"), (6, LONG), (7, "é" * 120), (8, "x"), (None, None)]
    return spark.createDataFrame([(i, t, None, "n", 1, 0.0) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


def test_near_duplicates(spark, sf_dir, docs):
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(QUERIES["op1_near_duplicates"](spark, sf_dir)).items()}
    assert got == brute.near_duplicates(docs)


@pytest.mark.parametrize("block, shingles", [(16, 1 << 20), (512, 1 << 20), (512, 2000)])
def test_near_copies_of_one_text(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(neardup, "SALT", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # copies at the edge of the threshold, in both directions
        words = [w if rng.random() > rng.choice([0.01, 0.04, 0.08]) else f"z{rng.integers(1e6)}" for w in base]
        rows.append((i, " ".join(words)))
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2)).items()}
    assert got == brute.near_duplicates(rows)


def test_links_grow_with_members(spark, monkeypatch):
    """Links of a group of near copies, few of which are similar enough, grow no faster than its members."""
    seen = []
    real = neardup._joined
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "_joined", lambda labels, links: seen.append(links.count()) or real(labels, links))
    rng, base, made = np.random.default_rng(5), [f"w{i}" for i in range(100)], {}
    for n in (250, 1000):
        rows = [(i, " ".join(w if rng.random() > 0.055 else f"z{rng.integers(1e6)}" for w in base)) for i in range(n)]
        seen.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()}
        made[n] = sum(seen)
        if n == 250:
            assert got == brute.near_duplicates(rows)
    assert made[250] <= 1000 and made[1000] <= 4000


def test_common_shingles_and_forest(monkeypatch):
    monkeypatch.setattr(neardup, "SLICE", 7)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    got = neardup.common_shingles(sets[:12], sets[12:])
    assert got.tolist() == [[len({*a.tolist()} & {*b.tolist()}) for b in sets[12:]] for a in sets[:12]]
    linked = np.ones((4, 5), bool)
    assert len(neardup.forest(linked, np.array([1, 1, 2, 3]), np.array([3, 4, 5, 6, 1]))) == 5


def test_near_duplicates_odd(odd, empty):
    found = neardup.near_duplicates(odd, keep=["text", "lang", "n_words", "chunk", "score"]).collect()
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found]
    assert sorted(map(str, rows)) == sorted(map(str, [(1, 12, 1, True), (2, 12, 1, False), (2, 12, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 13, 1, False), (6, 5, 6, True), (7, 1, 7, True), (8, 1, 8, True), (None, 0, None, True)]))
    assert sorted(str(r.doc_id) for r in found if r["first"]) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, None]))
    assert {r.doc_id: r.text for r in found}[6] == LONG and {(r.n_words, r.chunk, r.score, r.lang) for r in found} == {("n", 1, 0.0, None)}
    assert neardup.near_duplicates(empty).count() == 0


def test_repeated_rows_and_null_ids_leave_one_row(spark):
    rows = [(5, SAME), (5, SAME), (None, SAME), (None, "other words entirely here now"), (None, "other words entirely here now")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=["text"]).where("first").collect()
    assert sorted((str(r.doc_id), r.text) for r in found) == [("5", SAME), ("None", "other words entirely here now")]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.7, 0.8, 0.9):
        common = rng.integers(0, 1 << 63, int(1000 * share), np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, int(1000 * (1 - share) / 2), np.uint64)])) for _ in range(2))
        x, y = (neardup.odd_sketch(neardup.samples(s)).view(np.uint64) for s in (a, b))
        z = sum(int(v).bit_count() for v in x ^ y)
        estimate = 1 + neardup.SKETCH / (4 * neardup.BANDS * neardup.ROWS) * np.log(1 - 2 * z / neardup.SKETCH)
        assert abs(estimate - share) < 0.1


# 2


def test_media(spark, sf_dir, docs):
    got = by_id(QUERIES["op2_media_columns"](spark, sf_dir))
    for i, text in docs:
        data = text.encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.wav_bytes(data)
        assert media.wav_samples(stored) == payload and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_fingerprints(spark, sf_dir, docs):
    texts = sorted((t for _, t in docs if t), key=len)[:: max(1, len(docs) // 25)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.fingerprint for r in media.wav_features(media.to_wav(frame), keep=["doc_id"]).collect()}
    wrong = 0
    for i, text in enumerate(texts):
        data = text.encode()
        want = brute.fingerprint(data + bytes(-len(data) % 64))
        wrong += len({*want} ^ {*got[i]})
    assert wrong <= 0.01 * sum(map(len, got.values()))  # float32 may settle a near tie the other way


def test_media_frames_cover_the_end():
    for n in (64, 512, 576, 704, 768, 832):
        x = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
        y = x.copy()
        y[-60:] = 255 - y[-60:]
        one, other = (np.concatenate(list(media.spectrogram(v))) for v in (x, y))
        assert len(one) == 1 + max(0, -(-(n - media.FRAME) // media.HOP))
        assert not np.allclose(one[-1], other[-1])


def test_media_peaks_and_odd(odd, empty):
    t = np.arange(media.RATE)
    tone = (128 + 60 * np.sin(2 * np.pi * 1000 * t / media.RATE) * (1 + np.sin(2 * np.pi * 4 * t / media.RATE)) / 2).astype(np.uint8)
    _, bins = media.peaks(tone)
    assert np.any(np.abs(bins - 1000 * media.FRAME / media.RATE) <= 1)
    codes = media.fingerprint(tone)
    assert len(codes) and np.all(np.diff(codes) >= 0)
    rows = media.wav_features(media.to_wav(odd), keep=["doc_id", "n_bytes"]).collect()
    assert len(rows) == 11 and len({r.media_sha256 for r in rows if r.n_bytes == 0}) == 1 and all(r.fingerprint == [] for r in rows if r.n_bytes == 0)
    assert media.to_wav(empty).count() == 0


# 3


def test_urls(spark):
    words = {w: 50 for w in ("cheap", "pills", "best", "news")}
    known = lambda s: {(i, k): words[s[i : i + k]] for i in range(len(s)) for k in range(1, len(s) - i + 1) if s[i : i + k] in words}
    split = lambda s: urls.viterbi(s, known(s), 200.0)
    assert split("cheappills") == ["cheap", "pills"] and split("bestnews") == ["best", "news"] and split("qzxv") == ["qzxv"]
    rows = [(1, "HTTP://A.Example.COM/en/7x?q"), (2, "http://example.com/en/1"), (3, "x://b.net/de/8"), (4, "x://example.net/de/8"), (5, "nothing"), (6, None), (7, "x://notexample.com/fr"), (8, "x://cheappills.org/a"), (9, "x://cheap-pills.org/a"), (10, "x://news.org?x/y"), (11, "x://" + "a" * 3000 + "/p"), (11, "x://" + "a" * 3000 + "/p")]
    host, path = urls.split_url(F.col("url"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string").select("page_id", host.alias("host"), path.alias("path"))
    from factengine.llm.queries import URL_RULES

    got = {r.page_id: r for r in urls.judge(pages).withColumn("hit", urls.match_rules(F.col("host"), F.col("path"), URL_RULES)).collect()}
    assert (got[1].host, got[1].path, got[1].hit.rule) == ("a.example.com", "/en/7x", "example.com/en/7")
    assert [got[i].hit and got[i].hit.rule for i in (2, 3, 4, 5, 6, 7)] == ["com/en/", "net/de/", "example.net/de/8", None, None, None]
    assert (got[10].host, got[10].path, got[5].host, got[6].path) == ("news.org", "", "", "")
    assert got[8].block_score > got[10].block_score
    assert urls.judge(pages.limit(0)).count() == 0


def test_urls_whole_table(spark):
    from factengine.llm.queries import URL_RULES

    pages = [tuple(r.values()) for r in pq.read_table(f"{SMALL}/pages.parquet", columns=["page_id", "url"]).to_pylist()]
    want = brute.url_verdicts(pages, URL_RULES, urls.LEXICON, urls.SEEDS)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op3_url_filter"](spark, SMALL).collect()}
    assert got == want and {v for *_, v in want.values()} == {"allow", "block"}


def test_urls_clashing_columns(spark):
    rows = [(1, "x://cheap-pills.org/a", "k", 1.0), (None, None, None, None)]
    host, path = urls.split_url(F.col("url"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, token string, odds double").select("*", host.alias("host"), path.alias("path"))
    assert [(r.token, r.odds) for r in urls.judge(pages).orderBy(F.desc_nulls_last("page_id")).collect()] == [("k", 1.0), (None, None)]


# 4


def test_lm_base_and_model(spark, sf_dir, docs):
    got = by_id(QUERIES["op4_lm_scoring"](spark, sf_dir))
    tokens = {i: [w for ws in lm.split_words()(t.encode()) for w in ws] + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    counts = {}
    for i, ws in tokens.items():
        for w in ws if not held[i] else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(got[i].score for i in got if held[i]) > sum(got[i].base_score for i in got if held[i])


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    cells = np.unique(rng.integers(0, lm.START, 3000) * lm.CLASSES**2 + rng.integers(0, lm.START, 3000) * lm.CLASSES + rng.integers(0, lm.START, 3000))
    table = lm.log10_table(lm.train(cells, rng.integers(1, 9, len(cells))))
    assert np.allclose((10.0**table).sum(axis=1), 1, atol=1e-4)


def test_lm_classes_grow_with_the_vocabulary(spark):
    assert lm.class_sizes(1000) < lm.class_sizes(1_000_000) < lm.class_sizes(100_000_000)
    rng = np.random.default_rng(1)
    # each of 40 first words is followed by its own second one; they end alike, and not all are among the 62 most frequent
    texts = [" ".join(f"w{i:02}aaa v{i:02}aaa" for i in rng.permutation(40)) for _ in range(500)]
    rest = " ".join(f"r{i}" for i in range(120_000))
    frame = spark.createDataFrame([*enumerate(texts), (-1, rest), (-2, "w39aaa v39aaa"), (-3, "w39aaa v03aaa")], "doc_id bigint, text string")
    got = by_id(lm.score(frame, F.col("doc_id") >= -1))
    fair = got[-2].base_score - got[-3].base_score
    assert got[-2].score - got[-3].score - fair > 0.5


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    frame = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(60))) for i in range(60)], "doc_id bigint, text string")
    one, other = (by_id(lm.score(frame.repartition(k), F.lit(True))) for k in (1, 5))
    assert all(one[i].score == pytest.approx(other[i].score, rel=1e-5) for i in one)


def test_lm_odd(odd, empty):
    learn = F.lit(True)
    rows = [(r.n_tokens, r.score) for r in lm.score(odd, learn).collect()]
    assert len(rows) == 11 and all(np.isfinite(s) for _, s in rows) and sum(n == 1 for n, _ in rows) == 4
    assert lm.score(empty, learn).count() == 0
    assert all(r.n_known == 0 for r in lm.score(odd, F.lit(False)).collect())


# 5


def test_suffix_dedup(spark, sf_dir, docs):
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(QUERIES["op5_suffix_dedup"](spark, sf_dir)).items()}
    assert got == brute.repeated_bytes(docs)


@pytest.mark.parametrize("shard", [300, 1 << 20])
def test_suffix_arrays(monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    rng = np.random.default_rng(shard)
    for _ in range(15):
        base = bytes(rng.integers(97, 99, 200).astype(np.uint8))
        contexts = sorted({base[a : a + int(rng.integers(16, 85))] for a in rng.integers(0, 116, int(rng.integers(1, 50))).tolist()})
        ids = rng.integers(0, 20, len(contexts))
        first = {}
        for c, i in zip(contexts, ids):
            for p in range(len(c) - 49):
                first[c[p : p + 50]] = min(first.get(c[p : p + 50], 99), i)
        want = [sum(int(first[c[p : p + 50]] < i) << p for p in range(len(c) - 49)) for c, i in zip(contexts, ids)]
        assert suffix.earlier_windows(contexts, ids).tolist() == want


def test_suffix_periodic_and_shared(spark):
    rng = np.random.default_rng(2)
    passage = "".join(chr(c) for c in rng.integers(97, 123, 400))
    rows = [(9, "ab" * 300), (3, "ba" * 200 + passage), (5, "x" * 70 + passage[100:] + "é" * 40), (1, passage[:49]), (7, passage[30:90] + "y" * 51), (8, "y" * 50 + passage[:60]), (4, "é" * 60), (2, passage[:120] + LONG[:5000]), (6, LONG[:3000] + passage[200:])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.repeated_bytes(rows)


def test_suffix_odd(odd, empty):
    rows = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix.dedup_substrings(odd).collect())
    n = len(SAME)
    assert rows == sorted([("1", n, 0), ("2", n, n), ("2", n, n), ("3", 0, 0), ("4", 0, 0), ("5", 4, 0), ("None", n + 5, n), ("6", len(LONG), 0), ("7", 240, 0), ("8", 1, 0), ("None", 0, 0)])
    assert suffix.dedup_substrings(empty).count() == 0


# 6


def test_chat_layouts(spark):
    said = "<|im_end|> <\\|x|> <\\\\| end <"
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": said}]}, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": said}]},
        {"prompt": "hi", "response": said}, {"prompt": "hi", "completion": said}, {"instruction": "hi", "output": said}, {"question": {"text": "hi"}, "answer": {"text": said}},
    ]
    rows = [(i, 0, json.dumps(r)) for i, r in enumerate(records)] + [(100, 0, "{broken"), (101, 0, None), (102, 0, '{"other": 1}')]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, record string"), "record", ["conv_id", "turn"])
    assert turns.where("role is null").count() == 3
    formatted = chat.format_turns(turns, ["conv_id", "turn", "part", "role", "text"]).cache()
    assert [p for r in formatted.where("conv_id = 0").orderBy("part").collect() for p in chat.parse(r.formatted)] == [("user", "hi"), ("assistant", said)]
    back = chat.read_back(formatted, "conv_id", ["turn", "part", "role", "text"]).collect()
    want = (2, hashlib.sha256(f"user\nhi\nassistant\n{said}\n".encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(back) == 6 and all((r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want for r in back)


def test_chat_roles_stay(spark):
    records = [{"message": {"role": "human", "content": "a"}}, {"messages": [{"role": "model", "content": "b"}]}, {"conversations": [{"from": "human", "value": "c"}]}]
    frame = spark.createDataFrame([(i, json.dumps(r), "x") for i, r in enumerate(records)], "conv_id bigint, record string, role string")
    assert [r.role for r in chat.canonical_turns(frame, "record", ["conv_id"]).orderBy("conv_id").collect()] == ["human", "model", "user"]
    assert chat.read_back(chat.format_turns(chat.canonical_turns(frame.limit(0), "record", ["conv_id"]), ["conv_id", "part"]), "conv_id", ["part"]).count() == 0


def test_chat_odd(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 0, "assistant", "x" * 100_000), (2, None, "odd\nrole\\", "a")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns, ["conv_id", "turn", "role", "text"]), "conv_id", ["turn", "role", "text"]).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].loss_chars) == (3, 0, 100_000)
    assert got[2].turns_sha256 == hashlib.sha256(b"odd\nrole\\\na\n").hexdigest()


# 7


def test_toxicity(spark):
    table = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.train(table("documents"), table("labels"), fold != 0)
    scored = toxicity.score(table("documents"), model).join(table("labels"), "doc_id").where(fold == 0).collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in scored) / len(scored)
    assert right >= 0.95 and all(0 <= r.score <= 1 for r in scored)


def test_toxic_sentences_are_located(spark, odd, empty):
    clean = [(i, f"A fine day number {i}. Nothing to see.") for i in range(40)]
    rude = [(100 + i, f"Calm start é{i}. You horrid villain! Calm end.") for i in range(40)]
    docs = spark.createDataFrame(clean + rude, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in rude] + [(100, 0), (None, 1), (5, None), (999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    for r in toxicity.score(docs, model, keep=["doc_id", "text"]).collect():
        assert (r.score >= 0.5) == (r.doc_id >= 100)
        if r.doc_id >= 100:
            assert "villain" in r.text[r.worst.start : r.worst.end] and "Calm" not in r.text[r.worst.start : r.worst.end]
    assert toxicity.score(odd, model).count() == 11 and toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(empty, labels, F.lit(True))
    assert all(r.score == 0 for r in toxicity.score(odd, nothing).collect())


# 8


def test_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (1 + i % 7)) for i in range(1500)] + [(3, "http://h/3", "<p>3</p>" * 4)] * 5 + [(None, None, None)]
    pages = warc.with_record_ids(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    bad = [7, 700, 1400]
    replica = pages.withColumn("html", F.when(F.col("page_id").isin(bad), F.concat(F.lit("!"), "html")).otherwise(F.col("html")))
    left, right = warc.warc_records(pages), warc.warc_records(replica)
    found = warc.audit(left, right).collect()
    assert sorted(r.page_id for r in found) == bad and all(r.expected != r.found for r in found)
    assert warc.audit(left, left).count() == 0
    lost = warc.audit(left, left.where(~F.col("page_id").eqNullSafe(9))).collect()
    assert {(r.page_id, r.found) for r in lost if r.page_id == 9} == {(9, None)}
    fewer = warc.audit(left, left.withColumn("copies", F.when(F.col("page_id") == 3, 4).otherwise(F.col("copies")))).collect()
    assert [(r.page_id, r.expected == r.found, r.expected_copies, r.found_copies) for r in fewer] == [(3, True, 6, 4)]
    twice = pages.where("page_id < 20").withColumn("key", F.lit("0")).withColumn("junk", F.lit(1))
    assert warc.audit(warc.warc_records(twice), warc.warc_records(twice)).count() == 0
    long = warc.with_record_ids(spark.createDataFrame([(1, "u", LONG)], "page_id bigint, url string, html string"))
    assert warc.warc_records(long).first().length > len(LONG)
    assert left.where("page_id = 3").first().copies == 6 and warc.audit(left.limit(0), right.limit(0)).count() == 0


# 9


def ranks():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def test_bpe(spark, sf_dir, docs):
    import tiktoken

    vocabulary, pattern = ranks()
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
    got = by_id(QUERIES["op9_byte_bpe"](spark, sf_dir))
    for i, text in docs:
        ids = coder.encode_ordinary(text)
        r = got[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_odd(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 1000)
    vocabulary, pattern = ranks()
    encoded = bpe.encode(odd, vocabulary, pattern, keep=["doc_id", "text"])
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.encode(odd, vocabulary, pattern, keep=["doc_id", "text"], decoded=True).collect())
    rows = bpe.decode(encoded, vocabulary, keep=["doc_id", "text"]).collect()
    assert len(rows) == 11 and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.encode(empty, vocabulary, pattern).count() == 0
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(b"a\xff b").cast("string").alias("text"))
    assert bytes(bpe.encode(broken, vocabulary, pattern, decoded=True).first().decoded) == "a\ufffd b".encode()


# 10


def test_contamination(spark, sf_dir, docs):
    items = [tuple(r.values()) for r in pq.read_table(f"{SMALL}/benchmark.parquet", columns=["item_id", "text"]).to_pylist()]
    want = brute.contamination(docs, items)
    got = by_id(QUERIES["op10_decontamination"](spark, sf_dir))
    assert any(hit for _, hit, _ in want.values())
    for i, (n, hit, met) in want.items():
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(met), hashlib.sha256(",".join(met).encode()).hexdigest())
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


@pytest.mark.parametrize("shard, piece", [(4 << 20, 4 << 20), (60, 40)])
def test_contamination_pieces_and_odd(spark, odd, empty, monkeypatch, shard, piece):
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
    monkeypatch.setattr(decontam, "PIECE", piece)
    items = [(1, SAME), (2, None), (3, ""), (4, "Lorem, ipsum"), (5, "x"), (None, "ééé")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [(1, "Say: ONE-two three four five six seven eight nine ten eleven twelve thirteen! x ééé lorem... ipsum"), (2, "ééé"), (3, SAME * 3), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = brute.contamination(texts, [(i, t) for i, t in items if i is not None] + [(9, "ééé")])
    for r in decontam.find_contamination(docs, bench, keep=["doc_id", "text"]).collect():
        n, hit, met = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.items) == (n, hit, [x for x in met if x != "9"])
        if r.doc_id == 1:
            assert [r.text[s.start : s.end] for s in r.spans][0].startswith("ONE-two") and r.text[r.spans[-1].start : r.spans[-1].end].endswith("ipsum")
    assert decontam.find_contamination(odd, bench).count() == 11
    assert decontam.find_contamination(empty, bench).count() == 0
    assert decontam.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# pipeline


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as P

    now = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit(1))
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, now, sf_dir).cache()
        assert after.columns == P.COLUMNS
        rows = [(r.doc_id, r.text) for r in now.collect()]
        kept = {r.doc_id: r.text for r in after.collect()}
        if name == "near_duplicates":
            groups = brute.near_duplicates(rows, k=5)
            assert set(kept) == {i for i, (_, c) in groups.items() if c == i}
        if name == "repeated_passages":
            assert {i: len(t.encode()) for i, t in kept.items() if "\ufffd" not in t} == {i: n - gone for i, (n, gone, _, _) in brute.repeated_bytes(rows).items() if "\ufffd" not in kept[i]}
        if name == "decontamination":
            items = [tuple(r.values()) for r in pq.read_table(f"{SMALL}/benchmark.parquet", columns=["item_id", "text"]).to_pylist()]
            bad = {i for i, (n, hit, _) in brute.contamination(rows, items).items() if hit and 20 * hit >= n}
            assert set(kept) == {i for i, _ in rows} - bad
        now = after
    last = P.STAGES[-1][1](spark, now, sf_dir)
    assert last.where("round_trip").count() == now.count()
    assert P.run(spark, sf_dir).count() == now.count()


def test_same_block_is_compared_once(spark):
    from factengine.llm.neardup import _once

    blocks = {(1, 0, 0): [(5, 5, 1), (7, 7, 0)], (2, 0, 0): [(7, 7, 0), (5, 5, 1)], (3, 0, 0): [(5, 5, 0), (7, 7, 1)], (4, 0, 1): [(5, 5, 1), (7, 7, 0), (9, 9, 0)]}
    rows = spark.createDataFrame([(*k, *m) for k, ms in blocks.items() for m in ms], "band bigint, mb int, qb int, cls bigint, comp bigint, asks int")
    want = sorted((*k, *m) for k, ms in blocks.items() if k != (2, 0, 0) for m in ms)
    once = _once(rows)
    assert once.columns == rows.columns and sorted(map(tuple, once.collect())) == want
