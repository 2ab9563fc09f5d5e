"""Fill-in-middle: texts cut at two token ranks, found in an indexable skip list.

A text's units are ``[A-Za-z]+|[^A-Za-z]``, left to right over code points. They
form the base lane of a skip list; every lane above links a part of the nodes
below it, chosen by a hash of their position, and each link carries the units
and the code points that it spans. A rank is found from the top lane down: a
link is taken while the units passed do not exceed the rank, so the code points
passed are the cut, in a logarithmic number of steps for each cut.

Defined results: null texts are empty; bytes that are no UTF-8 count as U+FFFD;
ids may be null (then the seed has no digits) or repeat, each row is formatted
by itself; empty texts and texts that hold a marker stay plain; texts of any
length are cut whole; an empty table gives no rows; columns that are not named
in ``keep`` are ignored.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import fields, map_rows, with_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One node in 1 << SPREAD is linked in the next lane.
SPREAD = 2


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit."""
    point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = (point | 32) - 97 < 26  # wraps below, as unsigned
    starts = np.ones(len(point), bool)
    starts[1:] = ~(letter[1:] & letter[:-1])
    return np.diff(np.flatnonzero(starts), append=len(point)).astype(np.int32)


def _heights(n: int) -> np.ndarray:
    """Lanes above the base that a node takes part in, geometric in a hash of its position."""
    height = np.empty(n, np.int8)
    for at in range(0, n, 1 << 20):  # in parts, as the hashes take eight times the room of the heights
        x = np.arange(at + 1, min(n, at + (1 << 20)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        low = x & (~x + np.uint64(1))  # the lowest bit set
        height[at : at + len(x)] = np.log2(low.astype(np.float64).clip(min=1)).astype(np.int8) // SPREAD
    return height


class SkipList:
    """Lanes from the base up: (units, code points, node below) of each link."""

    def __init__(self, widths: np.ndarray):
        self.size, self.width = len(widths), int(widths.sum())
        units, points, below = np.ones(len(widths), np.int32), widths, None
        height = _heights(len(widths))
        self.lanes = [(units, points, below)]
        while len(units) > 4:
            rises = height > len(self.lanes) - 1
            rises[0] = True  # the head is in every lane
            below = np.flatnonzero(rises)
            if len(below) == len(units):
                break
            units, points = np.add.reduceat(units, below), np.add.reduceat(points, below)
            height = height[below]
            self.lanes.append((units, points, below))

    def offset(self, rank: int) -> int:
        """Code points before the unit of this rank; rank ``size`` is the end."""
        passed = offset = at = 0
        for units, points, below in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                offset += int(points[at])
                at += 1
            if passed == rank:
                break
            at = int(below[at])  # not in the base lane, whose links of one unit reach every rank
        return offset


def fill_in_middle(docs: DataFrame, keep: list[str] = ("doc_id",), seed: Column | None = None, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """keep + (n, form, prefix_chars, middle_chars, output).

    ``seed`` is a string per row, by default ``1:`` and its doc_id; its SHA-256
    decides cuts and form. ``fim_percent`` of the texts are cut, and of those
    ``spm_percent`` have the suffix first.
    """
    keep = list(keep)
    if seed is None:
        seed = F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(seed.cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"__h{i + 1}") for i in range(4)]
    needed = [c for c in docs.columns if c in keep or c == "text"]
    plain, text = with_text(docs.select(*needed, *draws), [*keep, *(f"__h{i}" for i in range(1, 5))])
    reads = [*text, "__h1", "__h2", "__h3", "__h4"]

    def make():
        def row(r):
            raw, h1, h2, h3, h4 = r
            value = raw.decode(errors="replace")
            lanes = SkipList(unit_widths(value))
            if not value or h3 % 100 >= fim_percent or any(m in value for m in (PREFIX, SUFFIX, MIDDLE)):
                return lanes.size, "plain", None, None, value
            a, b = sorted((h1 % (lanes.size + 1), h2 % (lanes.size + 1)))
            a, b = lanes.offset(a), lanes.offset(b)
            head, middle, tail = value[:a], value[a:b], value[b:]
            if h4 % 100 < spm_percent:
                return lanes.size, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"
            return lanes.size, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}"

        return row

    made = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    # what is kept passes by; the text and the draws go no further
    passed = plain.select(*keep, *(c for c in reads if c not in keep))
    return map_rows(passed, make, fields(docs, keep) + made, kept=len(keep), reads=reads)


def restore(output: Column, form: Column) -> Column:
    """The text of an output. A marker's last character begins no marker, so the first ones found are those set."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    psm = F.concat(part(1), part(3), part(2))
    return F.when(form == "psm", psm).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
