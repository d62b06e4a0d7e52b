"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn - text, image, audio, document - into one string, in
order. What is not text becomes a placeholder and an attachment reference with the tokens that
it expands to. A template marks the turns; inside texts and roles ``\\``, ``#`` and ``<`` become a backslash
and a letter, reversibly, so that no control string occurs in them.

``format_turns`` works row by row. ``read_back`` parses the formatted turns of a conversation in
order; it streams through a sorted partition and keeps running digests and counts only, so a
conversation of any length needs no more memory than its longest turn (a digest of one
conversation is sequential by definition, so its rows do meet in one task).

Defined results: a null text is empty, a null role is the empty role, equal turn numbers are
ordered by role and text as they were before escaping, null turn numbers come first, repeated rows
are turns of their own, null conversation ids are one conversation, an empty table gives no rows;
a text of any length is one row and is held whole; a part of unknown type is an error that names
it, since a turn without it would be another turn; further columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import bounded_batches, column

#: The template: marker, role, marker, text, marker. Control strings start with "#" or "<".
TURN_OPEN, ROLE_END, TURN_CLOSE = "### ", ": ", " </turn>\n"
ASSISTANT = "assistant"
#: What a special sign becomes after a backslash.
_LETTERS = {"\\": "\\", "#": "h", "<": "l", ":": "c"}
_SIGNS = {v: k for k, v in _LETTERS.items()}
_ESCAPED = re.compile(r"[\\#<]")
_ESCAPED_ROLE = re.compile(r"[\\#<:]")
_ROLE = re.compile(r"((?:[^\\:]|\\.)*): ", re.S)
_UNESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + _LETTERS[m[0]], text)


def escape_role(role: str) -> str:
    """Also before a colon, which ends the role."""
    return _ESCAPED_ROLE.sub(lambda m: "\\" + _LETTERS[m[0]], role)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: _SIGNS[m[1]], text)


@dataclass
class Flattened:
    """What the visitor has gathered: text pieces (escaped), attachments (kind, ref, tokens)."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)
    expanded_tokens: int = 0

    @property
    def text(self) -> str:
        return "".join(self.pieces)


class PartVisitor:
    """Visits parts {"type", ...}: text {"text"}, image {"ref", "width", "height"}, audio
    {"ref", "seconds"}, document {"ref", "pages"}. Token counts are parameters."""

    def __init__(self, patch: int = 28, tokens_per_second: float = 25.0, tokens_per_page: int = 600):
        self.patch, self.tokens_per_second, self.tokens_per_page = patch, tokens_per_second, tokens_per_page

    def flatten(self, parts) -> Flattened:
        out = Flattened()
        for part in parts or []:
            if part is None:  # says nothing
                continue
            getattr(self, "visit_" + str(part["type"]), self.unknown)(part, out)
        return out

    def unknown(self, part, out: Flattened) -> None:
        raise ValueError(f"a part of unknown type {part['type']!r}")

    def visit_text(self, part, out: Flattened) -> None:
        out.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part, out: Flattened) -> None:
        self._attach(out, "image", part, -(-int(part.get("width") or 1) // self.patch) * -(-int(part.get("height") or 1) // self.patch))

    def visit_audio(self, part, out: Flattened) -> None:
        self._attach(out, "audio", part, int(-(-float(part.get("seconds") or 0) * self.tokens_per_second // 1)))

    def visit_document(self, part, out: Flattened) -> None:
        self._attach(out, "document", part, int(part.get("pages") or 1) * self.tokens_per_page)

    @staticmethod
    def _attach(out: Flattened, kind: str, part, tokens: int) -> None:
        out.pieces.append(f"<{kind}:{len(out.attachments)}>")
        out.attachments.append((kind, part.get("ref") or "", tokens))
        out.expanded_tokens += tokens


PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FORMATTED = "conv_id bigint, turn bigint, formatted string, attachments array<struct<kind:string,ref:string,tokens:bigint>>, expanded_tokens bigint"


def text_part(text: Column) -> Column:
    """One text part as the ``parts`` column of a turn."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).cast(PARTS)


def format_turns(turns: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """From (conv_id, turn, role, parts): one row per turn with its formatted string."""
    visitor = visitor or PartVisitor()
    bounded_batches(turns.sparkSession)

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            flat = [visitor.flatten(p) for p in rows["parts"]]
            formatted = [f"{TURN_OPEN}{escape_role(r or '')}{ROLE_END}{f.text}{TURN_CLOSE}" for r, f in zip(rows["role"], flat, strict=True)]
            attachments = [[{"kind": k, "ref": r, "tokens": t} for k, r, t in f.attachments] for f in flat]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(formatted, pa.string()), pa.array(attachments, pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), pa.array([f.expanded_tokens for f in flat], pa.int64())],
                names=["conv_id", "turn", "formatted", "attachments", "expanded_tokens"],
            )

    return turns.select("conv_id", "turn", "role", "parts").mapInArrow(run, FORMATTED)


def parse_turn(formatted: str) -> tuple[str, str]:
    """The role and the (still escaped) body of a formatted turn."""
    if not (formatted.startswith(TURN_OPEN) and formatted.endswith(TURN_CLOSE)):
        raise ValueError("not a formatted turn")
    body = formatted[len(TURN_OPEN) : -len(TURN_CLOSE)]
    role = _ROLE.match(body)
    if role is None:
        raise ValueError("a formatted turn without a role")
    return unescape(role[1]), body[role.end() :]


class _Reader:
    """Running results of one conversation."""

    def __init__(self):
        self.n = self.loss = self.chars = 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        role, body = parse_turn(formatted)
        text = unescape(body)
        self.n += 1
        self.chars += len(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        if role == ASSISTANT:
            self.loss += len(text)
            self.masked.update(text.encode())

    def row(self):
        return self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the formatted turns of each conversation, in order, and digest what they say."""

    def run(batches):
        key, reader, rows = None, None, []
        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if reader is None or conv != key:
                    if reader is not None:
                        rows.append((key, *reader.row()))
                    key, reader = conv, _Reader()
                reader.add(text)
            if len(rows) > 10_000:
                yield _batch(rows)
                rows = []
        if reader is not None:
            rows.append((key, *reader.row()))
        if rows:
            yield _batch(rows)

    # the first colon ends the role, as those inside it are escaped
    role = F.substring_index(F.expr(f"substring(formatted, {len(TURN_OPEN) + 1})"), ":", 1)
    body = F.expr(f"substring(formatted, {len(TURN_OPEN) + len(ROLE_END) + 1} + length(role), length(formatted) - length(role) - {len(TURN_OPEN) + len(ROLE_END) + len(TURN_CLOSE)})")
    placed = formatted.select("conv_id", "turn", "formatted").repartition("conv_id").withColumn("role", role)
    placed = placed.sortWithinPartitions("conv_id", "turn", _unescaped(F.col("role")), _unescaped(body))
    return placed.select("conv_id", "formatted").mapInArrow(run, READ)


def _unescaped(text: Column) -> Column:
    """``unescape`` as a column: escaped backslashes part what holds other escapes only."""
    piece = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def conversation_turns(df: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Plain texts as turns of one text part each."""
    return df.select(column(conv).cast("bigint").alias("conv_id"), column(turn).cast("bigint").alias("turn"), column(role).alias("role"), text_part(F.coalesce(column(text), F.lit(""))).alias("parts"))
