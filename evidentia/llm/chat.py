"""Chat formatting with typed content parts.

A turn's content is a list of typed parts: text, image, audio, document. A visitor walks them in order
and flattens them: text is escaped, any other part becomes a placeholder numbered within its turn, and
leaves an attachment record with its reference and the number of tokens that it will expand to.

    <|turn|>ROLE<|says|>CONTENT<|end|>

Escaping is reversible and works character by character: a backslash is doubled, and every angle and
square bracket that could open a control string becomes a backslash and a letter. No control string is
left in a text, however the text is cut into parts. A conversation is the concatenation of its turns' fragments in order. Fragments are made turn by
turn, without a shuffle; no conversation is ever gathered into one value, whatever its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import bounded

#: The marks of the template.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
LEARNED_ROLE = "assistant"

#: Tokens that parts expand to: a patch is PATCH x PATCH pixels; audio has so many frames a second, a page so many tokens, text a token for so many bytes.
PATCH, AUDIO_RATE, PAGE_TOKENS, TEXT_BYTES = 28, 25, 256, 4

#: What is escaped: the escape itself, and the characters that open marks, sentence signs and instruction signs of public templates.
_CONTROL = re.compile(r"[\\<\[]")
_CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_CODE = re.compile(r"\\([\\lb])")
_PLAIN = {"\\": "\\", "l": "<", "b": "["}
_PARSE = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.DOTALL)
_PLACE = re.compile(r"<\|(?:image|audio|document|unknown):\d+\|>")

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "struct<place: int, kind: string, ref: string, tokens: bigint>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _PLAIN[m[1]], text)


@dataclass
class Flattener:
    """The visitor: visit() takes one part after the other; out, spans, attachments and tokens are what comes of them."""

    out: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0
    length: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_unknown)(part)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        start = self.length
        self.put(escape(text))
        if text:
            self.spans.append((start, self.length))
            self.tokens += -(-len(text.encode("utf-8", "surrogatepass")) // TEXT_BYTES)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"place": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.put(f"<|{kind}:{len(self.attachments) - 1}|>")
        self.tokens += tokens

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, max(1, -(-max(0, part.get("width") or 0) // PATCH)) * max(1, -(-max(0, part.get("height") or 0) // PATCH)))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, math.ceil(max(0.0, part.get("seconds") or 0.0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, part.get("pages") or 0) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        self.attach("unknown", part, 1)


def text_part(text: Column) -> Column:
    """An array of one text part, for tables whose turns are plain texts."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def json_parts(text: Column) -> Column:
    """Typed parts from a JSON list of parts; a text that isn't one is a single text part."""
    parsed = F.from_json(text, f"array<{PART}>")
    return F.when(text.rlike(r"^\s*\[\s*\{") & parsed.isNotNull(), parsed).otherwise(text_part(text))


def format_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text") -> DataFrame:
    """One fragment per turn: conv, turn, role, fragment, loss (spans of learned text in the fragment), attachments, tokens.

    parts: a column of array<PART>; by default the text column as one text part. A null role or text
    reads as empty, a null or empty list of parts as no content, null parts are skipped, and parts of
    unknown type become placeholders. Spans count code points of the fragment. Repeated rows are
    repeated turns. Other columns are ignored.
    """
    conv_kind, turn_kind = turns.schema[conv_col].dataType.simpleString(), turns.schema[turn_col].dataType.simpleString()
    parts = parts if parts is not None else text_part(F.col(text_col))
    rows = bounded(turns).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), parts.alias("parts"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column(2).to_pylist()
            fragments, loss, attachments, tokens = [], [], [], []
            for role, content in zip(roles, batch.column(3), strict=True):
                visitor = Flattener()
                visitor.put(f"{TURN}{escape(role)}{SAYS}")
                for part in content.as_py() or ():
                    if part is not None:
                        visitor.visit(part)
                visitor.put(END)
                fragments.append("".join(visitor.out))
                loss.append([{"start": s, "end": e} for s, e in visitor.spans] if role == LEARNED_ROLE else [])
                attachments.append(visitor.attachments)
                tokens.append(visitor.tokens)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(fragments, pa.string()), pa.array(loss, span), pa.array(attachments, made), pa.array(tokens, pa.int64())],
                names=["conv", "turn", "role", "fragment", "loss", "attachments", "tokens"],
            )

    schema = f"conv {conv_kind}, turn {turn_kind}, role string, fragment string, loss array<struct<start: bigint, end: bigint>>, attachments array<{ATTACHMENT}>, tokens bigint"
    return rows.mapInArrow(render, schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text, unescaped; placeholders are left out of texts."""
    return [(unescape(m[1]), unescape(_PLACE.sub("", m[2]))) for m in _PARSE.finditer(formatted)]


def read_back(fragments: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read from the fragments: conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, n_tokens.

    Turns come in the order of turn (nulls first), then role and fragment. Each conversation streams
    through running digests, so that memory doesn't grow with its length; a digest of a sequence is
    sequential, so one conversation's fragments are read by one task. A null conversation is one; repeated
    rows are repeated turns; an empty table gives an empty one.
    """
    kind = fragments.schema["conv"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        n, chars, loss_chars, attached, tokens, turns, loss = 0, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            cols = list(zip(*done, strict=True))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "n_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], conv_type), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], names=names)
            done.clear()

        for batch in batches:
            conv_type = batch.column(0).type
            for conv, fragment, spans, many, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    if begun:
                        done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, attached, tokens))
                    now, begun = conv, True
                    n, chars, loss_chars, attached, tokens, turns, loss = 0, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse(fragment):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for x in spans:
                    text = unescape(fragment[x["start"] : x["end"]])
                    loss_chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(fragment)
                attached += many
                tokens += cost
            if len(done) >= 10_000:
                yield from flush()
        if begun:
            done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, attached, tokens))
            yield from flush()

    schema = f"`{conv_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, n_tokens bigint"
    ordered = fragments.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "fragment")
    return ordered.select("conv", "fragment", "loss", F.size("attachments"), "tokens").mapInArrow(stream, schema)
