"""Chat formatting with a grammar round trip.

Grammar of the rendered text, one turn after the other:

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     <<SYS>> text <</SYS>>
    any other  <|role|> role <|text|> text <|end|>

Control strings inside a text (or role) are escaped by a backslash. A text is first rendered as it
is; the deterministic parser reads the rendering back, and while the recovered turns differ from the
source, the conflicting texts are escaped. The loss mask lists code-point spans of assistant texts.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), ties by role and
text; repeated rows are repeated turns; a null conv_id is a conversation of its own; extra columns
are left out. A conversation is one output row, so its turns are gathered in one task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", *OTHER)
_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
_CONFLICT = re.compile(rf"{_CONTROL}|\\")
_ESCAPED = re.compile(rf"\\({_CONTROL}|\\)")
_TOKEN = re.compile(rf"\\(?:{_CONTROL}|\\)|({_CONTROL})")
_ROLE_OF = {v[0]: k for k, v in OPEN.items()}


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _render(turns: list[tuple[str, str]], escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
    out, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        body = escape(text) if i in escaped else text
        if role in OPEN:
            head, tail = OPEN[role][0] + " ", " " + OPEN[role][1]
        else:
            name = escape(role) if i in escaped else role
            head, tail = f"{OTHER[0]} {name} {OTHER[1]} ", f" {OTHER[2]}"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + tail)
        at += len(out[-1])
    return "".join(out), spans


class ParseError(ValueError):
    pass


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation, unescaped; ParseError if it does not follow the grammar."""
    turns, at = [], 0

    def until(control: str, start: int) -> tuple[str, int]:
        for m in _TOKEN.finditer(rendered, start):
            if m[1]:
                if m[1] != control or m.start() <= start or rendered[m.start() - 1] != " " or rendered[start] != " ":
                    raise ParseError(f"{m[1]} at {m.start()}")
                return unescape(rendered[start + 1 : m.start() - 1]) if m.start() - 1 > start else "", m.end()
        raise ParseError(f"no {control} after {start}")

    while at < len(rendered):
        m = _TOKEN.match(rendered, at)
        if not m or m[1] not in (*_ROLE_OF, OTHER[0]):
            raise ParseError(f"no turn at {at}")
        if m[1] in _ROLE_OF:
            role = _ROLE_OF[m[1]]
            text, at = until(OPEN[role][1], m.end())
        else:
            role, at = until(OTHER[1], m.end())
            text, at = until(OTHER[2], at)
        turns.append((role, text))
    return turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Rendered text and loss spans; conflicting turns are escaped until the parser gives the source back."""
    escaped: set[int] = set()
    while True:
        text, spans = _render(turns, escaped)
        try:
            back = parse(text)
        except ParseError:
            back = None
        if back == turns:
            return text, spans
        more = {i for i, (r, t) in enumerate(turns) if _conflicts(t) or _conflicts(r)} - escaped
        if not more:
            raise ValueError("the conversation cannot be rendered reversibly")
        escaped |= more


def _conflicts(text: str) -> bool:
    return "\\\\" in text or any(c in text for c in CONTROLS)


def format_chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_start, loss_end) of each conversation; offsets are code points."""
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def run(batches):
        for b in batches:
            got = [render([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([g[0] for g in got], pa.string()), pa.array([[s[0] for s in g[1]] for g in got], pa.list_(pa.int64())), pa.array([[s[1] for s in g[1]] for g in got], pa.list_(pa.int64()))], ["conv_id", "formatted", "loss_start", "loss_end"])

    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turns").mapInArrow(run, "conv_id long, formatted string, loss_start array<long>, loss_end array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted conversations."""

    def run(batches):
        for b in batches:
            rows = []
            for text, start, end in zip(b.column("formatted").to_pylist(), b.column("loss_start").to_pylist(), b.column("loss_end").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(start, end, strict=True))
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _quoted(c: str) -> str:
    return re.sub(r"([\[\]|\\])", r"\\\1", c)


_SQL_CONTROL = "|".join(_quoted(c) for c in CONTROLS)

SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE WHEN regexp_matches(text, '{_SQL_CONTROL}|\\\\\\\\') THEN len(regexp_extract_all(text, '{_SQL_CONTROL}|\\\\')) ELSE 0 END AS escapes FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(text) + escapes + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 27 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
