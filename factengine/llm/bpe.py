"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens are exploded with their positions, each distinct pre-token is encoded
once per word bucket, its ids are joined back and documents are reassembled by
position (see chunks). Decoding joins each id to the token-byte table, which is
the vocabulary: at most MAX_VOCABULARY rows, checked when it is read.

Defined results: null and empty texts give no ids and empty bytes; repeated rows
give repeated rows; ids of documents may be null or repeat; bytes that are not
UTF-8 are encoded as U+FFFD, once for each part that Python's decoder replaces.
"""

import base64
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .chunks import answer, pack_ints, reassemble, unpack_ints, unpack_words, word_chunks
from .common import bounded_batches, fields

MAX_VOCABULARY = 1 << 20
LONG = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_VOCABULARY}")
    return ranks


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The token-byte table: bytes at each id."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def _joined(tokens: pa.Array, ids: pa.Array) -> tuple[bytes, np.ndarray]:
    """All ids joined to their bytes, one after the other, and where each one's bytes begin and the last one's end."""
    if not len(ids):
        return b"", np.zeros(1, np.int64)
    found = pc.take(tokens, ids)
    return found.buffers()[2].to_pybytes(), np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """keep + ids array<int>: each match of ``pattern`` encoded separately, without special tokens; with ``decoded``, the ids' bytes beside them, as decode() gives them."""
    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def split():
        match = regex.compile(pattern)

        def words(text):
            text = text.decode(errors="replace")
            if len(text) < LONG:
                return [match.findall(text)]
            found = (m.group() for m in match.finditer(text))
            return iter(lambda: list(islice(found, 100_000)), [])

        return words

    def encoder():
        coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})

        def f(messages):
            known = {}
            for chunk, words, _ in messages:
                lengths, ids = [], []
                for w in unpack_words(words):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = coder._encode_single_piece(w)
                    lengths.append(len(got))
                    ids += got
                first = pack_ints(np.array(lengths, np.uint32))
                yield chunk, len(first).to_bytes(4, "little") + first + pack_ints(np.array(ids, np.uint32))

        return f

    def joiner():
        tokens = token_bytes(sent.value) if decoded else None

        def row(d, ids):
            head = *(d[c] for c in keep), ids
            return (*head, _joined(tokens, pa.array(ids))[0]) if decoded else head

        def f(docs, words, answers):
            lengths, ids, slots = [], [], []
            for w in words:
                data = answers[w["bucket"]]
                n = int.from_bytes(data[:4], "little")
                lengths.append(unpack_ints(data[4 : 4 + n]))
                ids.append(unpack_ints(data[4 + n :]).astype(np.int32))
                slots.append(unpack_ints(w["slots"]))
            if words:
                slot = np.concatenate(slots).astype(np.int64)
                size, start = np.zeros((2, len(slot)), np.int64)
                size[slot] = found = np.concatenate(lengths)
                start[slot] = np.cumsum(found) - found
                ids = np.concatenate(ids)
            for d in docs:
                seq = unpack_ints(d["seq"])
                if not len(seq):
                    yield row(d, np.zeros(0, np.int32))
                    continue
                n = size[seq]
                at = np.repeat(start[seq] - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield row(d, ids[at])

        return f

    chunks = word_chunks(docs, keep, split, name="bpe")
    return reassemble(chunks, answer(chunks, encoder), [*keep, "seq", "bucket", "slots"], joiner, fields(docs, keep) + "ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int], keep: list[str] = ("doc_id", "ids")) -> DataFrame:
    """keep + decoded binary: ids joined to the token-byte table in id order, bytes concatenated by position. An id outside the table fails the job."""
    keep = list(keep)
    bounded_batches(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        tokens = token_bytes(sent.value)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            blob, ends = _joined(tokens, ids.flatten())
            lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = ends[np.concatenate([[0], np.cumsum(lengths)])]
            texts = pa.array([blob[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*keep, "decoded"])

    return encoded.select(*keep, F.col("ids").alias("_ids")).mapInArrow(run, fields(encoded, keep) + "decoded binary")
