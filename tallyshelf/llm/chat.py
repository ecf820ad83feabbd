"""Chat formatting: typed content parts become one marked text with placeholders, a loss mask and attachments.

A turn is written as <|turn|>role<|text|>content<|end|>. Control strings inside role and content, this
template's and other common ones, are escaped by a backslash after their first character; a string that
looks escaped already gets one more, so reading back is exact. A conversation is formatted in pieces of
whole turns; one longer than a piece is dealt over tasks by ranges of its turns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.llm.common import column, join_small
from tallyshelf.llm.tokens import encoder
from tallyshelf.session import settle

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "file": "<|file|>"}
#: Each opens with its only '<' or '[', so no two can overlap.
CONTROL = (TURN, TEXT, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>",
           "<|endoftext|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")
ESCAPED = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL)
_ESCAPED = re.compile(ESCAPED)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
#: Characters from which a piece is closed after its turn; a conversation with more is dealt by turns.
PIECE = 1 << 20


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """Inverse of ``escape``; placeholders, which have no backslash, stay."""
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


@dataclass(frozen=True)
class Costs:
    """Token ids that an attachment takes when its placeholder is expanded."""
    patch: int = 14              # an image gives one per patch of so many pixels square
    audio_per_second: float = 25
    document_page: int = 256


@dataclass
class Flattened:
    """Visits the content parts of one turn in order."""
    costs: Costs
    text: list[str] = field(default_factory=list)
    plain: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    size: int = 0

    def visit(self, part: dict) -> None:
        kind = (part.get("kind") or "text").lower()
        getattr(self, f"visit_{kind}", self.visit_file)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self._write(escape(text))
        self.plain.append(text)

    def visit_image(self, part: dict) -> None:
        width, height = part.get("width") or 0, part.get("height") or 0
        self._attach("image", part, max(1, math.ceil(width / self.costs.patch) * math.ceil(height / self.costs.patch)))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.costs.audio_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.costs.document_page)

    def visit_file(self, part: dict) -> None:
        self._attach("file", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.size, "tokens": tokens})
        self._write(PLACEHOLDERS[kind])

    def _write(self, text: str) -> None:
        self.text.append(text)
        self.size += len(text)


_MASK = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_FILES = pa.list_(pa.struct([("turn", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
_PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("mask", _MASK),
                    ("attachments", _FILES), ("n_turns", pa.int64()), ("n_tokens", pa.int64())])
_PIECE_SQL = ("conv_id bigint, piece bigint, formatted string, mask array<struct<start: bigint, stop: bigint>>, attachments "
              "array<struct<turn: bigint, kind: string, ref: string, at: bigint, tokens: bigint>>, n_turns bigint, n_tokens bigint")
PART = "kind string, text string, ref string, width int, height int, seconds double, pages int"


def format_conversations(rows: DataFrame, trained: tuple[str, ...] = ("assistant",), costs: Costs = Costs(),
                         tokenizer: str | None = None) -> DataFrame:
    """Pieces of each conversation: formatted text, loss mask, attachments, turns and expanded tokens.

    ``rows`` has conv_id, turn, role and text, and may have ``parts``, an array of structs (PART), which
    then stands instead of the text where it is not null. Turns go by turn, role and text, so repeated
    turns stand side by side; null text, role and parts are empty, a null conv_id is one conversation, an
    unknown kind of part is a file. Pieces go by ``piece``, whose numbers may have gaps. Mask and attachment
    places are code points of the piece, an attachment's turn is counted in the piece (``attachments`` gives
    that in the conversation); under the mask is the content of the ``trained`` roles. Tokens of text are the
    tokenizer's, or else words. An empty table gives no piece.
    """
    has_parts = "parts" in rows.columns
    wanted = rows.select(
        column("conv_id").cast("bigint").alias("conv_id"), column("turn").alias("turn"),
        F.coalesce(column("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(column("text").cast("string"), F.lit("")).alias("text"),
        (column("parts") if has_parts else F.lit(None).cast(f"array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer) if tokenizer else None
        open_ = None  # of the piece at hand: conversation, piece number
        first = TaskContext.get().partitionId() << 32  # tasks hold ranges in order
        text, mask, files, turns, tokens, size = [], [], [], 0, 0, 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                [open_[0], open_[1], "".join(text), mask, files, turns, tokens], _PIECE)], schema=_PIECE)

        for batch in batches:
            for row in batch.to_pylist():
                if open_ is not None and (row["conv_id"] != open_[0] or size >= PIECE):
                    yield piece()
                    open_ = (open_[0], open_[1] + 1) if row["conv_id"] == open_[0] else None
                    text, mask, files, turns, tokens, size = [], [], [], 0, 0, 0
                if open_ is None:
                    open_ = (row["conv_id"], first)
                seen = Flattened(costs)
                for part in row["parts"] if row["parts"] is not None else [{"kind": "text", "text": row["text"]}]:
                    if part is not None:
                        seen.visit(part)
                head = TURN + escape(row["role"]) + TEXT
                start = size + len(head)
                text += [head, *seen.text, END]
                size = start + seen.size + len(END)
                if row["role"] in trained:
                    mask.append({"start": start, "stop": start + seen.size})
                files += [{**a, "turn": turns, "at": start + a["at"]} for a in seen.attachments]
                tokens += sum(a["tokens"] for a in seen.attachments) + (
                    sum(len(x) // known.type.itemsize for x in known.encode(seen.plain)) if known else sum(len(x.split()) for x in seen.plain))
                turns += 1
        if open_ is not None:
            yield piece()

    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    size = F.length("role") + F.length("text") + F.coalesce(F.aggregate(
        "parts", F.lit(0), lambda n, p: n + F.coalesce(F.length(p["text"]), F.lit(0))), F.lit(0))
    long = settle(wanted.groupBy(key.alias("key")).agg(F.sum(size.cast("bigint")).alias("size")).filter(F.col("size") > PIECE).select(
        "key", F.lit(True).alias("long")))
    wanted = join_small(wanted.withColumn("key", key), long, ["key"], "left", 100)
    within = [F.when(F.col("long"), c) for c in (F.col("turn"), F.col("role"), F.substring("text", 1, 64))]
    dealt = wanted.repartitionByRange("conv_id", *within).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.drop("key", "long").mapInArrow(run, _PIECE_SQL)


def attachments(pieces: DataFrame) -> DataFrame:
    """Attachments of settled pieces, a row each: (conv_id, turn, kind, ref, tokens, piece, at, placeholder).

    ``turn`` counts the conversation's turns from 0; ``placeholder`` is what stands at that place of the piece.
    Only the pieces' counts are put in order, not their texts. No attachments give no row.
    """
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.select("piece", F.col("conv_id").alias("of"), F.coalesce(F.sum("n_turns").over(before), F.lit(0)).alias("before"))
    found = pieces.filter(F.size("attachments") > 0).select("conv_id", "piece", "formatted", F.explode("attachments").alias("a")).select(
        "conv_id", "piece", "a.*", F.substring(F.col("formatted"), F.col("a.at").cast("int") + 1, F.lit(max(map(len, PLACEHOLDERS.values())))).alias("there"))
    same = found["conv_id"].eqNullSafe(counts["of"]) & (found["piece"] == counts["piece"])
    return found.join(counts, same).select(
        "conv_id", (F.col("before") + F.col("turn")).alias("turn"), "kind", "ref", "tokens", found["piece"], "at",
        F.regexp_extract("there", r"^<\|[a-z]+\|>", 0).alias("placeholder"))


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and contents of a formatted piece, unescaped."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def digests(pieces: DataFrame) -> DataFrame:
    """What each conversation's pieces hold, read back from them alone; a conversation is hashed as it passes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row() -> pa.RecordBatch:
            values = [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _DIGEST)], schema=_DIGEST)

        for batch in batches:
            for p in batch.to_pylist():
                if state is not None and p["conv_id"] != conv:
                    yield row()
                    state = None
                if state is None:
                    conv, state = p["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(p["formatted"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for m in p["mask"]:
                    lost = unescape(p["formatted"][m["start"]:m["stop"]])
                    state[2] += len(lost)
                    state[3].update(lost.encode())
                state[4] += len(p["formatted"])
        if state is not None:
            yield row()

    return pieces.select("conv_id", "piece", "formatted", "mask").repartition("conv_id").sortWithinPartitions(
        "conv_id", "piece").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                            "loss_sha256 string, formatted_chars bigint")
