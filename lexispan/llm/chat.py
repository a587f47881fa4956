"""Conversations rebuilt from event logs and rendered for training.

An event has conv_id, message_id, seq, step, kind, role and text. Kinds: start (opens a message with a role and
perhaps first text), delta (appends), edit (replaces the text), regenerate (discards what was generated).
Events are dealt by conversation and message, sorted by (seq, step) and folded one message at a time; messages
are then dealt by conversation, sorted by their place, and rendered as a stream: a conversation of any length
passes through a task in parts of bounded size and is never held whole.

A turn is `### role`, a line break, the text, a line break and `</turn>`. Texts and roles are escaped: a backslash
is doubled and the control strings are broken by one, so neither `###` nor `</turn>` can come from a text, and
unescaping gives the text back exactly. The loss mask lists the spans of assistant texts.

Defined results: null texts and roles are empty; messages with equal places are ordered by role and text, and
repeated rows are separate turns; a null turn comes last; a null conv_id is a conversation of its own; an empty
table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

#: Characters after which a part of a long conversation is passed on.
PART_CHARS = 1_000_000
LOSS_ROLE = "assistant"

_TEXT_ESCAPE = re.compile(r"\\|(?<=##)#|(?<=<)/(?=turn>)")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _TEXT_ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def unescape_role(role: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def fold(events: Iterator[tuple]) -> tuple[str, str]:
    """(role, text) of one message from its events (kind, role, text) in order; unknown kinds are skipped."""
    role, pieces = "", []
    for kind, who, text in events:
        text = text or ""
        if kind == "start":
            role, pieces = who or "", [text]
        elif kind == "delta":
            pieces.append(text)
        elif kind == "edit":
            pieces = [text]
        elif kind == "regenerate":
            pieces = []
    return role, "".join(pieces)


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, seq, message_id, role and text of each message."""
    names = ["conv_id", "message_id", "seq", "step", "kind", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("message_id", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, own = None, None, []
        for batch in batches:
            out = []
            for conv, message, seq, _, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and (conv, message) != key:
                    out.append((key[0], first, key[1], *fold(own)))
                    own = []
                if not own:
                    key, first = (conv, message), seq
                own.append((kind, role, text))
            yield _batch(out, schema)
        if own:
            yield _batch([(key[0], first, key[1], *fold(own))], schema)

    dealt = events.select(*names).repartition("conv_id", "message_id").sortWithinPartitions("conv_id", "message_id", F.col("seq").asc_nulls_last(), "step")
    return mapped(dealt, run, "conv_id long, seq long, message_id string, role string, text string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def render_messages(messages: DataFrame) -> DataFrame:
    """conv_id, part, formatted and loss_mask (spans of code points in this part of the text)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss_mask", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, text, size, mask = None, 0, [], 0, []
        for batch in batches:
            out = []
            for own, role, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if text and (own != conv or size >= PART_CHARS):
                    out.append((conv, part, "".join(text), mask))
                    part, text, size, mask = part + 1, [], 0, []
                if own != conv:
                    part = 0
                conv, words = own, words or ""
                head, body = f"### {escape_role(role or '')}\n", escape(words)
                if role == LOSS_ROLE:
                    mask.append({"start": size + len(head), "end": size + len(head) + len(body)})
                text.append(f"{head}{body}\n</turn>\n")
                size += len(text[-1])
            yield _batch(out, schema)
        if text:
            yield _batch([(conv, part, "".join(text), mask)], schema)

    # the text itself orders turns that share a place, a message_id those that share the text too
    dealt = messages.repartition("conv_id").sortWithinPartitions("conv_id", F.col("seq").asc_nulls_last(), "role", "text", "message_id")
    return mapped(dealt.select("conv_id", "role", "text"), run, "conv_id long, part int, formatted string, loss_mask array<struct<start:long,end:long>>")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a rendered text: control strings can only be the template's own."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index("\n</turn>\n", line)
        yield unescape_role(formatted[at + 4 : line]), unescape(formatted[line + 1 : end])
        at = end + len("\n</turn>\n")


def digests(rendered: DataFrame) -> DataFrame:
    """What the rendered texts say when read again: turns and loss text of each conversation, as digests."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        close = lambda: (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in batches:
            out = []
            for own, part, formatted, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is not None and (own != conv or part == 0):
                    out.append(close())
                    state = None
                if state is None:
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in mask or ():
                    text = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            yield _batch(out, schema)
        if state is not None:
            yield _batch([close()], schema)

    dealt = rendered.select("conv_id", "part", "formatted", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return mapped(dealt, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def event_log(rows: DataFrame, delta_chars: int = 256) -> DataFrame:
    """The log that a chat service keeps for such turns: assistant texts are begun, discarded and streamed again in
    deltas, other texts are begun and edited. Equal rows become separate messages."""
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    copies = turns.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("n")
    copies = copies.withColumn("message_id", F.concat_ws("-", F.hex(F.xxhash64("seq", "role", "text")), F.col("copy").cast("string")))
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    event = lambda step, kind, text: F.struct(step.cast("int").alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    n_deltas = F.greatest(F.ceil(F.length("text") / delta_chars), F.lit(1)).cast("int")
    deltas = F.transform(F.sequence(F.lit(1), n_deltas), lambda k: event(k + 1, "delta", F.substring(F.col("text"), (k - 1) * delta_chars + 1, F.lit(delta_chars))))
    none = F.lit(None).cast("string")
    streamed = F.concat(F.array(event(F.lit(0), "start", half), event(F.lit(1), "regenerate", none)), deltas)
    typed = F.array(event(F.lit(0), "start", half), event(F.lit(1), "edit", F.col("text")))
    made = copies.select("conv_id", "message_id", "seq", "role", F.explode(F.when(F.col("role") == LOSS_ROLE, streamed).otherwise(typed)).alias("e"))
    return made.select("conv_id", "message_id", "seq", "e.step", "e.kind", "role", "e.text")


def format_conversations(events: DataFrame) -> DataFrame:
    """Rendered parts of every conversation, written to the shared folder."""
    return written(render_messages(fold_events(events)), "chat")
