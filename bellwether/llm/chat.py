r"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

The fingerprint of a record is a hash of its nested field paths (array elements share a path).
It selects a mapping; a mapping says where the turns, roles and texts are. The canonical turns
go through a template that marks turns and escapes its control strings inside texts with a
backslash, so that everything can be read back from the output.

Each turn is formatted by itself, so a conversation of any length is never gathered.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.llm.common import unused

END = "</turn>"
MARK = "###"


@dataclass(frozen=True)
class Mapping:
    """How to read one layout. ``example`` has the layout's fields (values don't matter).

    ``turns``: path of a list of turns, with ``role`` and ``text`` paths within an element; or
    ``parts``: (role, path) pairs in order, for layouts with one field per turn. Empty or absent
    parts give no turn. ``position``: path of the turn's number, for one record per turn.
    """

    name: str
    example: dict
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, str], ...] = ()
    position: str = ""
    joined: str = "\n"


#: Roles as other layouts call them. Fixed values.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Mapping("turn rows", {"turn": 0, "role": "", "text": ""}, role="role", text="text", position="turn"),
    Mapping("messages", {"messages": [{"role": "", "content": ""}]}, turns="messages", role="role", text="content"),
    Mapping("shared chats", {"conversations": [{"from": "", "value": ""}]}, turns="conversations", role="from", text="value"),
    Mapping("prompt", {"prompt": "", "completion": ""}, parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt with system", {"system": "", "prompt": "", "response": ""}, parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", {"instruction": "", "input": "", "output": ""}, parts=(("user", "instruction+input"), ("assistant", "output"))),
    Mapping("question", {"data": {"question": "", "answer": ""}}, parts=(("user", "data.question"), ("assistant", "data.answer"))),
)


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}") for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def schema_fingerprint(record) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths(record))).encode()).hexdigest()[:16]


def registry(layouts: tuple[Mapping, ...] = LAYOUTS) -> dict[str, Mapping]:
    return {schema_fingerprint(m.example): m for m in layouts}


def _at(value, path: str):
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _role(value) -> str:
    role = _text(value)
    return ROLES.get(role, role)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[int | None, str, str]]:
    """(number, role, text) of every turn of a record."""
    if mapping.turns:
        return [(k, _role(_at(t, mapping.role)), _text(_at(t, mapping.text))) for k, t in enumerate(_at(record, mapping.turns) or [])]
    if mapping.parts:
        texts = [(role, mapping.joined.join(x for x in (_text(_at(record, p)) for p in path.split("+")) if x)) for role, path in mapping.parts]
        return [(k, role, text) for k, (role, text) in enumerate((r, t) for r, t in texts if t)]
    number = _at(record, mapping.position)
    return [(number if isinstance(number, int) else None, _text(_at(record, mapping.role)), _text(_at(record, mapping.text)))]


def canonical_turns(records: DataFrame, key: str, record: str = "record", layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """(key, layout, turn, role, text) from records in JSON.

    Records of an unknown fingerprint, and null or broken ones, give one row with a null
    ``layout``, ``turn`` and ``role`` and the record as ``text``, so none is lost.
    """
    known = registry(layouts)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[frozenset, Mapping | None] = {}
        for frame in frames:
            out = []
            for k, raw in zip(frame["key"], frame["record"], strict=True):
                try:
                    value = json.loads(raw)
                except (TypeError, ValueError):
                    value = None
                paths = frozenset(field_paths(value))
                if paths not in seen:
                    seen = seen if len(seen) < 10_000 else {}
                    seen[paths] = known.get(schema_fingerprint(value))
                mapping = seen[paths] if isinstance(value, dict) else None
                out += [(k, None, None, None, raw)] if mapping is None else [(k, mapping.name, *t) for t in turns_of(value, mapping)]
            result = pd.DataFrame(out, columns=["key", "layout", "turn", "role", "text"])
            yield result.astype({"turn": "Int64"})

    kind = records.schema[key].dataType.simpleString()
    plain = records.select(F.col(key).alias("key"), F.col(record).alias("record"))
    if kind != "string":
        plain = plain.withColumn("key", F.col("key").cast("string"))
    turns = plain.mapInPandas(read, "key string, layout string, turn bigint, role string, text string")
    return turns.select(F.col("key").cast(kind).alias(key), "layout", "turn", "role", "text")


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace(MARK, r"\#\#\#").replace(END, "\\" + END)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(role: str, text: str) -> str:
    """``### role: text</turn>`` and a line end; a colon in a role is escaped too."""
    return f"{MARK} {escaped(role).replace(':', chr(92) + ':')}: {escaped(text)}{END}\n"


#: A turn in the output; in a role and a text, each backslash stands before the character that it escapes.
TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.S)


def read_back(piece: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of formatted text; start and end are those of the escaped text."""
    at = 0
    while at < len(piece):
        m = TURN.match(piece, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield unescaped(m[1]), unescaped(m[2]), m.start(2), m.end(2)
        at = m.end()


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and the loss mask within it (``loss_start``, ``loss_end``; equal where nothing is learned).

    Turns without a known layout are left out of the output: they have no role. Null roles and texts
    are empty. Other columns, repeated rows and ties stay as they are; an empty table gives an empty table.
    """

    @F.pandas_udf("formatted string, loss_start int, loss_end int")
    def write(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for role, text in zip(roles, texts, strict=True):
            piece = formatted(role, text)
            start = len(piece) - len(END) - 1 - len(escaped(text))
            out.append((piece, start, len(piece) - len(END) - 1 if role in learn else start))
        return pd.DataFrame(out, columns=["formatted", "loss_start", "loss_end"])

    mine = unused(turns, "written")
    judged = turns.filter(F.col("layout").isNotNull()).withColumn(mine, write(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    return judged.withColumns({c: F.col(f"{mine}.{c}") for c in ("formatted", "loss_start", "loss_end")}).drop(mine)


def digests(pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation: what is read back from the output. Turns go by number, then role and text.

    A SHA-256 needs a conversation's turns in order; the sorted rows are streamed through it and never held.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current, n, all_turns, loss_chars, loss, chars = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0

        def row():
            return (current[0], n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            done = []
            for key_, piece, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current != (key_,):
                    if current is not None:
                        done.append(row())
                    current, n, all_turns, loss_chars, loss, chars = (key_,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, text, _, _ in read_back(piece):
                    n += 1
                    all_turns.update(f"{role}\n{text}\n".encode())
                masked = unescaped(piece[start:end])
                loss_chars += len(masked)
                loss.update(masked.encode())
                chars += len(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(), kinds, strict=True)], names=names)

    kind = pieces.schema[key].dataType.simpleString()
    ordered = pieces.repartition(F.col(key)).sortWithinPartitions(key, "turn", "role", "text")
    plain = ordered.select(F.col(key).cast("string").alias("key"), "formatted", "loss_start", "loss_end")
    out = plain.mapInArrow(stream, "key string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return out.select(F.col("key").cast(kind).alias(key), *out.columns[1:])
