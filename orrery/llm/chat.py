"""Chat formatting of conversations whose turns hold typed content parts.

A visitor flattens text, image, audio and document parts into a turn's text,
with a placeholder for each attachment in its place; the attachment's reference
and the number of tokens that it expands to are recorded. Turns are marked by
control strings; a text that holds one (or a backslash) is escaped by a
backslash and can be restored exactly. The loss mask is a list of code point
ranges over the assistants' texts.

Defined results: null texts, roles and parts count as empty; turns are ordered
by (turn, role, content), null turns first, so that repeated rows all stay; an
empty table gives an empty result. A conversation is one output record and so
must fit in memory, as its text does.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
OPEN, CLOSE = "<s>", "</s>"
ASK, ASK_END = "[INST]", "[/INST]"
REPLY, REPLY_END = "[OUT]", "[/OUT]"
HOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

CONTROL = [OPEN, CLOSE, ASK, ASK_END, REPLY, REPLY_END, *HOLDERS.values()]
_any = "|".join(map(re.escape, CONTROL))
_escape = re.compile(rf"\\|{_any}")
_unescape = re.compile(rf"\\(\\|{_any})")
_scan = re.compile(rf"\\(?:\\|{_any})|({_any})")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OUTPUT = (
    "conv_id long, formatted string, loss array<struct<start:long,end:long>>, n_turns long, "
    "attachments array<struct<turn:int,kind:string,ref:string,at:long,tokens:long>>"
)


def escape(text: str) -> str:
    return _escape.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1", text)


class PartVisitor:
    """Flattens content parts; ``visit`` dispatches on a part's type.

    ``patch`` is the side of an image patch in pixels, ``rate`` the audio
    tokens of a second, ``page`` the tokens of a document page.
    """

    def __init__(self, patch: int = 14, rate: float = 25.0, page: int = 256):
        self.patch, self.rate, self.page = patch, rate, page

    def visit(self, part: dict) -> tuple[str, tuple[str, str, int] | None]:
        """The part's text in the output, and (kind, reference, tokens) of an attachment."""
        kind = part.get("type") or "text"
        if kind == "text":
            return escape(part.get("text") or ""), None
        if kind not in HOLDERS:
            raise ValueError(f"unknown part type {kind!r}")
        return HOLDERS[kind], (kind, part.get("ref") or "", getattr(self, f"visit_{kind}")(part))

    def visit_image(self, part: dict) -> int:
        return max(1, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> int:
        return max(1, math.ceil((part.get("seconds") or 0.0) * self.rate))

    def visit_document(self, part: dict) -> int:
        return max(1, part.get("pages") or 0) * self.page


def format_turns(turns: list[dict], visitor: PartVisitor) -> tuple[str, list, list]:
    """(formatted text, loss ranges, attachments) of a conversation's turns in order."""
    out: list[str] = []
    at = 0
    loss, attached = [], []

    def put(text: str) -> None:
        nonlocal at
        out.append(text)
        at += len(text)

    for i, turn in enumerate(turns):
        role = turn["role"] or ""
        reply = role == "assistant"
        put(OPEN)
        put(escape(role).replace("\n", "\\n"))
        put("\n" + (REPLY if reply else ASK))
        began = at
        for part in turn["parts"] or []:
            text, attachment = visitor.visit(part or {})
            if attachment:
                attached.append({"turn": i, "kind": attachment[0], "ref": attachment[1], "at": at, "tokens": attachment[2]})
            put(text)
        if reply:
            loss.append({"start": began, "end": at})
        put((REPLY_END if reply else ASK_END) + CLOSE)
    return "".join(out), loss, attached


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back; placeholders stay in the text."""
    turns, begun, body, role = [], 0, 0, ""
    for m in _scan.finditer(formatted):
        mark = m[1]
        if mark == OPEN:
            begun = m.end()
        elif mark in (ASK, REPLY):
            role = re.sub(r"\\(\\|n|" + _any + ")", lambda x: "\n" if x[1] == "n" else x[1], formatted[begun : m.start() - 1])
            body = m.end()
        elif mark in (ASK_END, REPLY_END):
            turns.append((role, unescape(formatted[body : m.start()])))
    return turns


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, visitor: PartVisitor | None = None) -> DataFrame:
    """One formatted record per conversation.

    ``parts_col`` names a column of typed parts (array of ``PART``); without
    it, ``text_col`` is the turn's only text part. Columns: conv_id, formatted,
    loss (code point ranges), n_turns, attachments.
    """
    visitor = visitor or PartVisitor()
    parts = F.col(parts_col) if parts_col else text_part(F.col(text_col))
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), parts.alias("parts"))
    grouped = turns.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.list_(pa.struct([("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                done = [format_turns(t, visitor) + (len(t),) for t in part.column(1).to_pylist()]
                cols = [part.column(0), [d[0] for d in done], [d[1] for d in done], [d[3] for d in done], [d[2] for d in done]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "formatted", "loss", "n_turns", "attachments"])

    return grouped.mapInArrow(write, OUTPUT)
