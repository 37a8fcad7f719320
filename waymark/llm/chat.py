r"""Chat formatting by prefix-target expansion.

A turn is written as ``[INST]role[/INST]text</s>``. Inside roles and texts a backslash is doubled and a control string
gets one behind its first character, so no control string stands inside and ``\x`` reads back as ``x``. Every assistant
turn is an example: all earlier turns of its conversation are the context, only its text is trainable. Each example is
written out with its whole context, which grows with the square of a conversation's turns, in pieces of some ``PIECE``
characters: a conversation is cut into stretches, and an example takes all stretches up to its own end, so no row and no
task holds a long conversation. Turns behind the last reply stand in a row without a mask. Rows that begin alike follow each
other and are written as what they add to the row before, so the files grow with the turns and the pieces, not with the text.

Defined cases: null texts and roles are empty; rows without a turn number come first; rows with one turn number stand
in the order of role and text; rows with a null conversation id are one conversation; a conversation without assistant
turns has no example. Reading back takes the turns from each conversation's longest row, the masked text and the sizes from
all examples, and streams over what is sorted, so a conversation of any length fits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.scratch import Scratch
from waymark.session import scratch_dir

PIECE = 1 << 13
_EXAMPLES = 1024  # at most in one list
CONTROLS = ["[INST]", "[/INST]", "</s>"]
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, segment, start, loss_start, loss_end, example_end, last``; offsets are null for turns that are no reply."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(F.lit("[INST]"), escaped(empty(role)), F.lit("[/INST]"))
    body = escaped(empty(text))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"),
                        head.alias("head"), body.alias("body"))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit("</s>")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn(
        "start", F.sum(F.length("segment").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("segment"))
    reply = lambda x, name: F.when(F.col("role") == "assistant", x).alias(name)
    loss_start = F.col("start") + F.length("head")
    return rows.select("conv_id", "place", "segment", "start", reply(loss_start, "loss_start"), reply(loss_start + F.length("body"), "loss_end"),
                       reply(F.col("start") + F.length("segment"), "example_end"), F.lead("place").over(order).isNull().alias("last"))


def expand(formatted: DataFrame) -> DataFrame:
    """``conv_id, place, piece, start, text, loss_start, loss_end, example_end, whole``: each example with all its context.

    ``text`` is the piece from ``start`` on, in characters from the conversation's begin. ``whole`` rows end with the last turn.
    """
    conv = F.struct("conv_id").alias("conv")  # null ids are an id like others
    cut = F.when(F.length("segment") <= PIECE, F.array("segment")).otherwise(F.regexp_extract_all("segment", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    parts = formatted.select(conv, "start", F.posexplode(cut).alias("i", "part")).withColumn("start", F.col("start") + F.col("i") * F.lit(PIECE).cast("bigint"))
    stretches = parts.groupBy("conv", F.floor(F.col("start") / PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "").alias("text"), F.min("start").alias("start"))
    ends = formatted.filter("example_end IS NOT NULL OR last").select(conv, "place", "loss_start", "loss_end", "example_end", F.col("last").alias("whole"), (F.col("start") + F.length("segment")).alias("until"))
    asked = ends.groupBy("conv", F.floor(F.col("place") / _EXAMPLES).alias("list")).agg(
        F.sort_array(F.collect_list(F.struct("place", "loss_start", "loss_end", "example_end", "whole", "until"))).alias("asked"), F.max("until").alias("most"))
    asked = asked.select("conv", "asked", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("most") - 1) / PIECE))).alias("piece"))
    rows = stretches.join(asked, ["conv", "piece"]).select("conv.conv_id", "piece", "start", "text", F.inline("asked")).filter("start < until")
    rows = rows.withColumn("text", F.when(F.col("until") >= F.col("start") + F.length("text"), F.col("text")).otherwise(
        F.substring("text", F.lit(1), (F.col("until") - F.col("start")).cast("int"))))
    return rows.select("conv_id", "place", "piece", "start", "text", "loss_start", "loss_end", "example_end", "whole")


def write_chat(turns: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Write the examples below the shared checkpoint folder, or to ``path``, and read them back."""
    path = path or scratch_dir(turns.sparkSession, "chat")
    scratch = Scratch(turns.sparkSession)
    # delta strings: a row is stored as what differs from the one before, its shared context once
    layout = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#text": "false"}
    expand(scratch.cut(format_turns(turns, **names))).write.options(**layout).parquet(path)
    scratch.clear()
    return turns.sparkSession.read.parquet(path)


def example_texts(chat: DataFrame) -> DataFrame:
    """``conv_id, place, text, loss_start, loss_end``: each written example as one text."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"])
    found = chat.filter("example_end IS NOT NULL").groupBy("conv_id", "place", "loss_start", "loss_end").agg(F.array_join(pieces, "").alias("text"))
    return found.select("conv_id", "place", "text", "loss_start", "loss_end")


def read_turn(segment: str) -> tuple[str, str]:
    """The role and text of a formatted turn."""
    role, text = _TURN.fullmatch(segment).groups()
    return _ESCAPED.sub(r"\1", role), _ESCAPED.sub(r"\1", text)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.loss, self.formatted = conv_id, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()
        self.escape, self.open, self.tail = "", [], ""  # what goes on in the next piece

    def add(self, chars: int, masked: str | None, turns: str | None) -> None:
        self.formatted += chars
        if masked is not None:
            masked = self.escape + masked
            self.escape = "\\" * ((len(masked) - len(masked.rstrip("\\"))) % 2)
            masked = _ESCAPED.sub(r"\1", masked[:len(masked) - len(self.escape)])
            self.loss += len(masked)
            self.masked.update(masked.encode())
        if turns is not None:
            self.open.append(turns)
            if "</s>" in self.tail + turns:
                held = "".join(self.open)
                end = held.rindex("</s>") + 4
                for segment in _TURN.finditer(held, 0, end):
                    role, text = read_turn(segment[0])
                    self.n += 1
                    self.turns.update(f"{role}\n{text}\n".encode())
                self.open = [held[end:]]
            self.tail = (self.tail + turns)[-3:]

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.formatted


def read_back(chat: DataFrame) -> DataFrame:
    """Per conversation: the turns, the text under the loss mask and the characters of all examples, from the written examples."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            for conv_id, *turn in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if current is None or current.conv_id != conv_id:
                    done += [current.row()] if current else []
                    current = _Digest(conv_id)
                current.add(*turn)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        if current:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(current.row(), schema.types, strict=True)], schema=schema)

    behind = F.col("start") + F.length("text")
    first, end = F.greatest("loss_start", "start"), F.least(F.col("loss_end"), behind)
    masked = F.when(F.col("loss_start").isNotNull() & (first < end), F.substring("text", (first - F.col("start") + 1).cast("int"), (end - first).cast("int")))
    rows = chat.select(F.col("conv_id").cast("bigint"), "place", "piece", F.when(F.col("example_end").isNotNull(), F.length("text")).otherwise(0).cast("bigint").alias("chars"),
                       masked.alias("masked"), F.when(F.col("whole"), F.col("text")).alias("turns"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", "piece").drop("place", "piece")
    return ordered.mapInArrow(digests, _DIGESTS)
