"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised byte for byte (A-Z lower-cased, other ASCII but letters and
digits blanked), so a position in the normalised text is a position in the
original. Documents are scanned once per automaton, without any shuffle.

The automaton holds at most SHARD_BYTES of window text; a larger benchmark is
split by hash into more automata, which scan the rows one after the other, so
neither the broadcast nor a worker grows with the benchmark.

Defined results: a null or empty text has no words and no hits; null ids are
kept as they are; repeated documents give repeated rows; repeated benchmark
windows name every item; an item without id hits but is never listed; an empty
benchmark leaves every document clean.
"""

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, fields, freeze, map_rows, with_text

WINDOW = 13
SHARD_BYTES = 4 << 20
PIECE = 4 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or b in _KEEP else 32 for b in range(256))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(pattern, items): each distinct window of ``window`` words, or a shorter item's whole text, with its item ids as sorted strings."""
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("pattern"))
        .groupBy("pattern")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _pieces(norm: bytes):
    """(words before, words) of stretches of about PIECE bytes, cut at blanks."""
    at, before = 0, 0
    while at < len(norm):
        end = norm.find(b" ", at + PIECE)
        words = norm[at : end if end >= 0 else len(norm)].split()
        yield before, words
        at, before = (end, before + len(words)) if end >= 0 else (len(norm), 0)


def _scan(norm: bytes, automaton, window: int) -> tuple[int, set[int], set[str]]:
    """Words, indexes of hit words, items met."""
    total, hit, items, tail = 0, set(), set(), []
    for before, words in _pieces(norm):
        total = before + len(words)
        first = before - len(tail)
        joined = b" " + b" ".join([*tail, *words]) + b" "
        if len(automaton):
            blanks = None
            for end, (length, names) in automaton.iter(joined.decode("latin-1")):
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                last = first + int(np.searchsorted(blanks, end))
                hit.update(range(last - length, last))
                items.update(names)
        tail = [*tail, *words][-(window - 1) :] if window > 1 else []
    return total, hit, items


def _spans(norm: bytes, hit: list[int]) -> list[dict]:
    """Hit words joined to maximal runs, as character offsets of the original text."""
    raw = np.frombuffer(norm, np.uint8)
    solid = np.concatenate([[False], raw != 32, [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    h = np.array(hit)
    cut = np.flatnonzero(np.diff(h) > 1) + 1
    return [{"start": int(chars[starts[run[0]]]), "end": int(chars[ends[run[-1]]])} for run in np.split(h, cut)]


def _automata(patterns: DataFrame):
    """Lists of at most about SHARD_BYTES of patterns and item names each, fetched one at a time."""
    names = F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 8)
    size = patterns.agg(F.sum(F.octet_length("pattern") + names)).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    for k in range(shards):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == k) if shards > 1 else patterns
        yield k == shards - 1, [(r.pattern.encode(), r.items) for r in part.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep + (n_words, n_hit, items, spans): words inside any benchmark window, the items met, and hit stretches in original characters."""
    spark = docs.sparkSession
    keep = list(keep)
    out, text = with_text(docs, keep)
    passed = out.columns
    state = "n_words bigint, __hit array<int>, __items array<string>"
    reads = text
    for last, part in _automata(freeze(benchmark_windows(benchmark, window), "benchmark_windows")):
        sent = spark.sparkContext.broadcast(part)

        def make(sent=sent, last=last):
            automaton = ahocorasick.Automaton()
            for pattern, names in sent.value:
                automaton.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, names))
            if len(automaton):
                automaton.make_automaton()

            def row(r):
                norm = r[0].translate(NORMAL)
                total, hit, items = _scan(norm, automaton, window)
                if len(r) > 1:  # what other automata have hit
                    hit, items = hit.union(r[1]), items.union(r[2])
                if not last:
                    return total, sorted(hit), sorted(items)
                return total, len(hit), sorted(items), _spans(norm, sorted(hit)) if hit else []

            return row

        schema = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>" if last else state
        out = map_rows(out, make, fields(out, passed) + schema, kept=len(passed), reads=reads)
        reads = [*text, "__hit", "__items"]
    return out.select(*keep, "n_words", "n_hit", "items", "spans")


def contaminated(share: int = 20):
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
