"""Chat formatting: schema fingerprints choose declarative mappings from record layouts to canonical turns.

A record is JSON. Its fingerprint is the hash of its sorted nested field paths;
LAYOUTS names the known ones and says which fields hold whose text. Turns are
formatted one by one as ``<|im_start|>role\\ntext<|im_end|>\\n``; inside texts a
backslash is added between ``<`` and ``|``, so a text never holds a control
string and unescaping is exact. Everything but the last step is row by row;
``read_back`` sorts turns within conversations and streams them, so a
conversation of any length is never held as a whole.

Defined results: null texts are empty; unknown layouts, broken JSON and null
records give one row with a null role and the fingerprint, which formatting
skips; turns sort by (turn, part, role, text), so ties have a fixed order and
repeated rows repeat; null conversation ids form one conversation.
"""

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, fields, map_rows

#: Names of roles in layouts that say from whom a value is; elsewhere roles stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def _layout(paths: str, *turns: tuple, each: str = "", roles: dict[str, str] | None = None) -> dict:
    """turns: (role or path of the role, path of the text); ``each``: the list they are taken from; ``roles``: what other names of roles mean in this layout."""
    return {"paths": sorted(paths.split()), "turns": turns, "each": each, "roles": roles or {}}


#: Declared layouts; ``[]`` stands for the entries of a list, ``=`` marks a fixed role.
LAYOUTS = [
    _layout("messages[].role messages[].content", ("role", "content"), each="messages"),
    _layout("conversations[].from conversations[].value", ("from", "value"), each="conversations", roles=ROLES),
    _layout("prompt response", ("=user", "prompt"), ("=assistant", "response")),
    _layout("prompt completion", ("=user", "prompt"), ("=assistant", "completion")),
    _layout("instruction input output", ("=system", "instruction"), ("=user", "input"), ("=assistant", "output")),
    _layout("instruction output", ("=user", "instruction"), ("=assistant", "output")),
    _layout("question.text answer.text", ("=user", "question.text"), ("=assistant", "answer.text")),
    _layout("prompt", ("=user", "prompt")),
    _layout("response", ("=assistant", "response")),
    _layout("message.role message.content", ("message.role", "message.content")),
]


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _get(value, path: str):
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def canonical_turns(records: DataFrame, record: str, keep: list[str]) -> DataFrame:
    """keep + (fingerprint, part, role, text): a row for each turn of each record."""
    keep = list(keep)

    def make():
        known = {fingerprint(x["paths"]): x for x in LAYOUTS}

        def row(r):
            try:
                value = json.loads(r[0])
                print_ = fingerprint(field_paths(value))
            except (TypeError, ValueError):
                value, print_ = None, None
            if not (layout := known.get(print_)):
                return print_, [{"part": 0, "role": None, "text": None}]
            turns = []
            for item in value[layout["each"]] if layout["each"] else [value]:
                for role, text in layout["turns"]:
                    who = role[1:] if role[0] == "=" else str(_get(item, role) or "")
                    said = _get(item, text)
                    turns.append({"part": len(turns), "role": layout["roles"].get(who, who), "text": "" if said is None else str(said)})
            return print_, turns

        return row

    turns = map_rows(records.select(*keep, record), make, fields(records, keep) + "fingerprint string, turns array<struct<part:int,role:string,text:string>>", kept=len(keep))
    return turns.select(*keep, "fingerprint", F.explode("turns").alias("t")).select(*keep, "fingerprint", "t.part", "t.role", "t.text")


def escape(column):
    return F.regexp_replace(column, r"<(\\*)\|", r"<$1\\|")


def format_turns(turns: DataFrame, keep: list[str]) -> DataFrame:
    """keep + (formatted, loss_start, loss_end): each turn's segment and the characters of it that the loss mask covers (an assistant's text)."""
    role = F.regexp_replace(F.regexp_replace(escape(F.col("role")), r"\\", r"\\\\"), "\n", r"\\n")
    head = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))
    text = escape(F.coalesce("text", F.lit("")))
    start = F.length(head)
    end = F.when(F.col("role") == "assistant", start + F.length(text)).otherwise(start)
    return turns.where(F.col("role").isNotNull()).select(*keep, F.concat(head, text, F.lit("<|im_end|>\n")).alias("formatted"), start.alias("loss_start"), end.alias("loss_end"))


_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def parse(formatted: str):
    """(role, text) of each turn of a formatted text."""
    for role, text in _TURN.findall(formatted):
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)
        yield unescape(role), unescape(text)


def read_back(formatted: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the formatted segments in order."""
    bounded_batches(formatted.sparkSession)
    schema = fields(formatted, [key]) + "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        done, state = [], None

        def table():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*done), arrow)], schema=arrow)

        def close():
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for k, text, a, b in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if state is None or state[0] != k:
                    if state:
                        close()
                    state = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                loss = unescape(text[a:b])
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(text)
            if len(done) >= 512:
                yield table()
                done = []
        if state:
            close()
        if done:
            yield table()

    rows = formatted.select(key, "formatted", "loss_start", "loss_end", *order)
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
