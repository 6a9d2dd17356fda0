"""Chat formatting of messages with typed content parts.

A message's content is a list of parts: text, image, audio or document. A visitor
flattens them in order: text is escaped, an attachment becomes a numbered placeholder, and its
reference and the number of tokens it will be expanded to are recorded. A conversation is
its turns between control strings::

    <|im_start|>role
    content<|im_end|>

Inside texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so no control string
can be forged and ``parse`` gives back every turn as it was. The loss mask holds the spans of
assistant text, without control strings and placeholders.

Defined results: null texts, roles and lists of parts are empty; a part of null or
unknown type counts as text; missing measures of an attachment, and durations that are no finite number, count as zero, and every
attachment has one token at least; a row without conv_id is a conversation of its own; turns that tie are ordered by role and content, null turns come
first; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<number:int,type:string,ref:string,at:long,tokens:long>>"
FORMATTED = f"conv_id long, formatted string, loss array<struct<start:long,stop:long>>, attachments {ATTACHMENTS}, expanded_tokens long"

# Tokens an attachment is expanded to.
TILE = 28  # pixels on a side
AUDIO_TOKENS_A_SECOND = 25
TOKENS_A_PAGE = 512

PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


@dataclasses.dataclass
class Attachment:
    number: int
    type: str
    ref: str
    at: int
    tokens: int


class Flattener:
    """Visits the parts of messages in order and writes one text."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []  # of text
        self.attachments: list[Attachment] = []

    def write(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit_all(self, parts: list[dict]) -> None:
        waiting = ""  # neighbouring texts are one text, so that no control string forms where they meet
        for part in parts:
            visit = getattr(self, f"tokens_of_{part['type']}", None) if part else None
            if visit is None:
                waiting += (part and part.get("text")) or ""
                continue
            self.text(waiting)
            waiting = ""
            self.attach(part, max(1, visit(part)))
        self.text(waiting)

    def text(self, text: str) -> None:
        if text:
            start = self.length
            self.write(escape(text))
            self.spans.append((start, self.length))

    def attach(self, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append(Attachment(number, part["type"], part.get("ref") or "", self.length, tokens))
        self.write(f"<|{part['type']}:{number}|>")

    def tokens_of_image(self, part: dict) -> int:
        return math.ceil((part.get("width") or 0) / TILE) * math.ceil((part.get("height") or 0) / TILE)

    def tokens_of_audio(self, part: dict) -> int:
        seconds = part.get("seconds") or 0
        return math.ceil(seconds * AUDIO_TOKENS_A_SECOND) if math.isfinite(seconds) else 0

    def tokens_of_document(self, part: dict) -> int:
        return (part.get("pages") or 0) * TOKENS_A_PAGE


def format_turns(turns: list[tuple[str, list[dict]]]) -> tuple[str, list[tuple[int, int]], list[Attachment]]:
    """Text, loss mask (spans of code points) and attachments of the (role, parts) of a conversation."""
    out, loss = Flattener(), []
    for role, parts in turns:
        out.write(f"{START}{escape_role(role)}\n")
        out.spans = []
        out.visit_all(parts)
        if role == LOSS_ROLE:
            loss += out.spans
        out.write(f"{END}\n")
    return "".join(out.pieces), loss, out.attachments


def parse(formatted: str) -> list[tuple[str, list[str | int]]]:
    """(role, content) per turn of a formatted text; content holds texts and attachment numbers in order."""
    turns = []
    for m in TURN.finditer(formatted):
        content: list[str | int] = []
        at = 0
        for p in PLACEHOLDER.finditer(m[2]):
            content += [unescape(m[2][at : p.start()]), int(p[2])]
            at = p.end()
        turns.append((unescape(m[1]), [*content, unescape(m[2][at:])]))
    return turns


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            text, loss, found = format_turns([(t["role"], t["parts"]) for t in turns])
            rows.append(
                {
                    "conv_id": conv,
                    "formatted": text,
                    "loss": [{"start": a, "stop": b} for a, b in loss],
                    "attachments": [dataclasses.asdict(a) for a in found],
                    "expanded_tokens": sum(a.tokens for a in found),
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        (
            "attachments",
            pa.list_(
                pa.struct(
                    [("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]
                )
            ),
        ),
        ("expanded_tokens", pa.int64()),
    ]
)


def formatted(messages: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, parts): its text, loss mask and attachments.

    A conversation is one text, so its turns meet in one task; nothing larger does. A row without
    conv_id is a conversation of its own.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role")
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)).alias("parts")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), role, parts).alias("row"))
    several = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    alone = rows.filter("conv_id IS NULL").select("conv_id", F.array("row").alias("turns"))
    return several.unionByName(alone).mapInArrow(_format, FORMATTED)


def text_messages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as messages of one text part."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.col("text").cast("string").alias("text"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))],
    )
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {n: [] for n in READ_BACK}
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            turns = parse(text)
            flat = "".join(f"{role}\n{''.join(c for c in content if isinstance(c, str))}\n" for role, content in turns)
            under = "".join(unescape(text[s["start"] : s["stop"]]) for s in loss)
            values = (conv, len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text))
            for name, value in zip(READ_BACK, values, strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(list(READ_BACK.items())))


READ_BACK = {
    "conv_id": pa.int64(),
    "n_turns": pa.int64(),
    "turns_sha256": pa.string(),
    "loss_chars": pa.int64(),
    "loss_sha256": pa.string(),
    "formatted_chars": pa.int64(),
}


def read_back(found: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from the formatted texts."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return found.select("conv_id", "formatted", "loss").mapInArrow(_read_back, schema)
