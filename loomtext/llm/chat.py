"""Chat formatting by schema fingerprints.

A record's nested field paths, sorted and hashed, select a declarative mapping
that says where its turns are: of the mappings whose paths it all has, the one
with most of them, so that further fields don't matter. Tables are fingerprinted once by their schema,
JSON records one by one. Turns become segments of a template that marks roles
and escapes control strings reversibly; a conversation's text is its segments
in order, so a conversation of any length is written and read as a stream.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions_for, table


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``each``: the field of a list of turns with fields ``role`` and ``text`` (""
    if every record is itself a turn, in order of ``order``). ``turns``: for a
    fixed exchange, roles with the fields whose texts, blank ones left out, are
    joined by an empty line. ``names``: other names of roles.
    """

    layout: str
    paths: tuple[str, ...]
    each: str | None = None
    role: str = ""
    text: str = ""
    order: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    names: tuple[tuple[str, str], ...] = ()


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("turn rows", ("role", "text", "turn"), "", "role", "text", "turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), "messages", "role", "content", names=_NAMES),
    Mapping("from-value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", names=_NAMES),
    Mapping("prompt-response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt-completion", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system-prompt-response", ("prompt", "response", "system"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction-input", ("input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)
_KNOWN = frozenset(p for m in MAPPINGS for p in m.paths)


def fingerprint(paths: Iterable[str]) -> str:
    """The hash of a layout: its paths, sorted. Paths that no mapping names (ids, scores, dates) don't count."""
    return xxhash.xxh64_hexdigest("\n".join(sorted(_KNOWN.intersection(paths))))


_BY_PRINT: dict[tuple[str, bool], Mapping | None] = {}


def mapping_of(paths: Iterable[str], rows: bool) -> Mapping | None:
    """The mapping for records of these paths; ``rows``: records may be turns themselves. Of equally good ones the first in order."""
    paths = _KNOWN.intersection(paths)
    key = fingerprint(paths), rows
    if key not in _BY_PRINT:
        fit = [m for m in MAPPINGS if paths.issuperset(m.paths) and (rows or m.each != "")]
        _BY_PRINT[key] = max(fit, key=lambda m: len(m.paths), default=None)
    return _BY_PRINT[key]


def value_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a parsed JSON value; lists add []."""
    if isinstance(value, dict):
        return set().union(*(value_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(value_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a Spark type."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind)) if len(kind) else {at}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


_LONE = re.compile("[\ud800-\udfff]")


def _text(value) -> str:
    """A value as text: null empty, other than text as JSON, halves of surrogate pairs as replacement characters."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _LONE.sub("\ufffd", text)


def turns_of_record(record) -> tuple[str | None, list[tuple[str, str]]]:
    """The layout of a parsed record and its turns; (None, []) if no mapping fits.

    Null texts are empty. In a list of turns nulls are left out, and whatever else
    isn't an object is a turn without a role.
    """
    m = mapping_of(value_paths(record), rows=False) if isinstance(record, dict) else None
    if m is None:
        return None, []
    names = dict(m.names)
    if m.each:
        found = [(_text(t.get(m.role)), _text(t.get(m.text))) if isinstance(t, dict) else ("", _text(t)) for t in record[m.each] if t is not None]
        return m.layout, [(names.get(r, r), t) for r, t in found]
    return m.layout, [(r, "\n\n".join(x for f in fields if (x := _text(record.get(f))).strip() or len(fields) == 1)) for r, fields in m.turns]


def turns_of_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON records, one row a turn; records that don't parse, are nested too deeply or match no mapping keep one row without turn and layout."""
    schema = pa.schema([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    layout, turns = turns_of_record(json.loads(raw or "null"))
                except (ValueError, RecursionError):  # not JSON, or nested too deeply to be a conversation
                    layout, turns = None, []
                found = [(i, r, t, layout) for i, (r, t) in enumerate(turns)] or [(None, None, None, layout)]
                rows += found
                keys += [k] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *table(rows, schema).columns], ["conv_id", *schema.names])

    return df.select(key, column).mapInArrow(run, f"conv_id {dict(df.dtypes)[key]}, turn bigint, role string, text string, layout string")


def turns_of_table(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table whose schema a mapping fits; raises ValueError if none does. Other columns don't matter. Native."""
    m = mapping_of(schema_paths(df.drop(key).schema), rows=True)
    if m is None:
        raise ValueError("no mapping fits these columns")
    if m.each == "":
        return df.select(F.col(key).alias("conv_id"), F.col(m.order).alias("turn"), F.col(m.role).alias("role"), F.col(m.text).alias("text"))
    names = F.create_map(*(F.lit(x) for pair in m.names for x in pair)) if m.names else None
    if m.each:
        rows = df.select(F.col(key).alias("conv_id"), F.posexplode_outer(m.each).alias("turn", "one"))
        role = F.col(f"one.{m.role}")
        return rows.select("conv_id", "turn", (F.coalesce(names[role], role) if m.names else role).alias("role"), F.col(f"one.{m.text}").alias("text"))
    text = lambda fields: F.col(fields[0]) if len(fields) == 1 else F.concat_ws("\n\n", *(F.when(F.trim(f) != "", F.col(f)) for f in fields))
    one = F.array(*(F.struct(F.lit(r).alias("role"), text(fields).alias("text")) for r, fields in m.turns))
    return df.select(F.col(key).alias("conv_id"), F.posexplode(one).alias("turn", "one")).select("conv_id", "turn", "one.role", "one.text")


_OPEN, _END = "<turn ", "</turn>\n"
_TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>\n((?:[^\\<]++|\\.)*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as segments of the template, one row a turn; native.

    Returns conv_id, turn, role, segment, and mask_start and mask_end: where in
    the segment the text lies that counts for the loss (null unless the role is
    assistant). ``segment`` is ``<turn ROLE>``, a line end, the text, ``</turn>``
    and a line end; a backslash escapes backslashes and angle brackets in roles
    and texts. A null role or text is empty. A conversation's text is the
    concatenation of its segments by turn (nulls first), then role and text.
    """
    escaped = lambda c, marks: F.regexp_replace(F.coalesce(c, F.lit("")), f"([{marks}])", "\\\\$1")
    head = F.concat(F.lit(_OPEN), escaped("role", r"\\<>"), F.lit(">\n"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), escaped("text", r"\\<").alias("body"))
    mask = lambda c: F.when(F.col("role") == "assistant", c)
    return rows.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(_END)).alias("segment"),
        mask(F.length("head")).alias("mask_start"), mask(F.length("head") + F.length("body")).alias("mask_end"),
    )


class Reader:
    """Reads formatted text that comes in pieces of any size."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """The turns (role, text) that ``piece`` completes."""
        self.rest += piece
        at = 0
        while m := _TURN.match(self.rest, at):
            yield _ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])
            at = m.end()
        self.rest = self.rest[at:]

    def close(self) -> None:
        if self.rest:
            raise ValueError("the text ends inside a turn")


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.reader = conv_id, Reader()
        self.turns = self.loss = self.chars = 0
        self.all, self.lost = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, start: int | None, end: int | None) -> None:
        self.chars += len(segment)
        for role, text in self.reader.feed(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = _ESCAPED.sub(r"\1", segment[start:end])
            self.loss += len(text)
            self.lost.update(text.encode())

    def row(self) -> tuple:
        self.reader.close()
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.lost.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, what reading its formatted text gives.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn),
    loss_chars, loss_sha256 (the unescaped text under the mask), formatted_chars.
    Segments are dealt by conversation, sorted and read as a stream: a
    conversation is one task's, but never held whole. A null conv_id is a
    conversation of its own; repeated rows are turns of their own; an empty table
    gives an empty result.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for conv, segment, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now.conv_id != conv:
                    rows += [now.row()] if now else []
                    now = _Digest(conv)
                now.feed(segment, start, end)
            yield table(rows, schema)
            rows = []
        if now:
            yield table([now.row()], schema)

    n = partitions_for(segments)
    ordered = segments.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "segment", "mask_start", "mask_end").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.select("conv_id", "segment", "mask_start", "mask_end").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
