"""Chat formatting by schema fingerprints.

The nested field paths of a record (``messages[].role``) are hashed; the hash selects a declared mapping that turns a
prompt, instruction or message layout into canonical turns (conversation, place, role, text). A table's own schema and
JSON records are fingerprinted alike.

The template marks each turn. Inside a text every start of a control string gets a backslash behind its first
character and a backslash is doubled, so that no text can be read as a mark and the text comes back unchanged.

Defined cases: a null text or role is empty; turns of a conversation are ordered by turn, role, text, nulls first. A
null conversation id is a conversation of its own. Repeated rows are turns of their own. Unknown layouts raise an
error for a table and give no turns for a JSON record. Extra columns and fields do not matter. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """Field paths, and which of them hold what. ``turns``: (role, field) in order, for records that are a whole conversation."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""


LAYOUTS = (
    Layout("rows", ("conv_id", "role", "text", "turn"), role="role", text="text"),
    Layout("messages", ("messages[].content", "messages[].role"), items="messages", role="role", text="content"),
    Layout("shared", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value"),
    Layout("prompt-completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt-response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("question-answer", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction-input", ("input", "instruction", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system-prompt", ("completion", "prompt", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_KNOWN = {p for x in LAYOUTS for p in x.paths}


def fingerprint(paths: set[str]) -> str:
    """The hash of those field paths that some layout names."""
    return hashlib.sha256("\n".join(sorted(paths & _KNOWN)).encode()).hexdigest()


MAPPINGS = {fingerprint(set(x.paths)): x for x in LAYOUTS}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else {at}


def record_paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in record_paths(v, f"{at}[]")}
    return {at}


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, turn, role, text)`` of a table in any declared layout; ``id_col`` names a record where rows are records."""
    layout = MAPPINGS.get(fingerprint(schema_paths(df.schema)))
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(schema_paths(df.schema))}")
    role = lambda c: F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[c], c, F.lit(""))
    if layout.name == "rows":
        return df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if layout.items:
        one = df.select(F.col(id_col).alias("conv_id"), F.posexplode(layout.items).alias("turn", "m"))
        return one.select("conv_id", F.col("turn").cast("long").alias("turn"), role(F.col(f"m.{layout.role}")).alias("role"), F.coalesce(f"m.{layout.text}", F.lit("")).alias("text"))
    said = F.array(*(F.struct(F.lit(r).alias("role"), F.coalesce(F.col(c), F.lit("")).alias("text")) for r, c in layout.turns))
    return df.select(F.col(id_col).alias("conv_id"), F.posexplode(said).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def record_turns(record: str | None) -> list[tuple[str, str]]:
    """(role, text) of a JSON record in any declared layout but rows; none for another record.

    A record is another one too if one of its messages is no object, or a role or text is neither a string nor null.
    """
    try:
        value = json.loads(record or "null")
    except ValueError:
        return []
    layout = MAPPINGS.get(fingerprint(record_paths(value))) if isinstance(value, dict) else None
    if layout is None or layout.name == "rows":
        return []
    if not layout.items:
        said = [(r, value[c]) for r, c in layout.turns]
    elif all(isinstance(m, dict) for m in value[layout.items]):
        said = [(m.get(layout.role), m.get(layout.text)) for m in value[layout.items]]
    else:
        return []
    if not all(x is None or isinstance(x, str) for turn in said for x in turn):
        return []
    return [(ROLES.get(r or "", r or ""), x or "") for r, x in said]


def json_turns(df: DataFrame, record: str = "record", id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, turn, role, text)`` of JSON records, each by its own fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, t, r, x) for i, rec in enumerate(b.column(1).to_pylist()) for t, (r, x) in enumerate(record_turns(rec))]
            at, turn, role, text = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int32())), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())], ["conv_id", "turn", "role", "text"])

    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record)).mapInArrow(run, "conv_id long, turn long, role string, text string")


# Control strings: fixed values of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn:", "<|end|>", "<|", "|>")
_START = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_BACK = re.compile(r"\\(\\?)")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|<\|turn:(?P<role>.*?)\|>(?P<other>.*?)<\|end\|>| (?P<assistant>.*?) </s>", re.S)


def escape(text: str) -> str:
    return _START.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turn(role: str, text: str, first: bool) -> tuple[str, int, int]:
    """A turn as the template writes it, and where in it the loss mask is set (from, to; equal if nowhere)."""
    said = escape(text)
    head, tail = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>\n"), "assistant": (" ", " </s>")}.get(role, (f"<|turn:{escape(role)}|>", "<|end|>"))
    head = "<s>" * first + head
    return head + said + tail, len(head), len(head) + len(said) * (role == "assistant")


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of formatted turns."""
    out, at = [], 3 if formatted.startswith("<s>") else 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at {at}")
        kind = m.lastgroup
        out.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return out


_FORMATTED = "conv_id long, turn long, formatted string, loss_from long, loss_to long"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: object = object()
    for b in batches:
        made = []
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            made.append(format_turn(role, text, conv != last))
            last = conv
        f, x, y = zip(*made, strict=True) if made else ((), (), ())
        yield pa.record_batch([b.column(0), b.column(1), pa.array(f, pa.string()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["conv_id", "turn", "formatted", "loss_from", "loss_to"])


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per turn, a conversation's rows together and in order: the output is their ``formatted`` in sequence."""
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, _FORMATTED)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its formatted rows; holds one row and two hash states at a time."""
    now: list | None = None
    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def done() -> tuple:
        return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

    for b in batches:
        out = []
        for conv, _, formatted, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(done())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse_turns(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            loss = unescape(formatted[x:y])
            now[3] += len(loss)
            now[4].update(loss.encode("utf-8", "surrogatepass"))
            now[5] += len(formatted)
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
    if now is not None:
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(done(), kind, strict=True)], schema=kind)


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of what format_chat() returned."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: DuckDB SQL for the columns read back; formatted lengths follow from the template's marks and escapes.
ORACLE_SQL = r"""
  with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
  e as (select *, length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|')) + len(regexp_extract_all(text, '\|>'))
      + case role when 'user' then 15 when 'system' then 18 when 'assistant' then 6 else null end as chars from t)
  select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    (sum(chars) + 3)::bigint as formatted_chars
  from e group by conv_id"""
