"""Packing tokenised documents into training windows as they come, with a fixed number of open windows.

A document is its token ids followed by an end id. Every partition reads its documents once, in order, and keeps at most
`open_windows` windows open. What a document has beyond whole windows is placed best-fit: in the open window that it
leaves least room in. When none fits and all are open, the fullest one is topped up with the head of the document and
emitted, so no window leaves a partition with room in it, and the rest of the document is placed again. Cuts are made
there and nowhere else but between the whole windows of a long document.

The windows that are open at a partition's end are leftovers. Their pieces travel with their ids (at most `open_windows`
windows a partition) and are merged in rounds: `fan_in` partitions' leftovers at a time are packed again by the same
rule, the longest piece first, until one lane is left. Its last windows are put together piece after piece, and
the last, partial one is cut at powers of two, so that the whole corpus ends without padding. No task sees more than
fan_in * open_windows windows of leftovers, however many partitions there are.

Pieces are written once and reread, so sequence numbers don't depend on how often a task runs.

Defined results: a null text is empty and takes one place (the end id); texts are tokenised whole, as the tokenizers
library has it; repeated rows are packed once each; null doc_ids are kept; an empty table gives no pieces; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, mapped, written
from .packing import Encoder

#: Windows that a partition keeps open, and partitions whose leftovers are merged in one task.
OPEN_WINDOWS, FAN_IN = 64, 16


class Piece(NamedTuple):
    """A stretch of a document's ids (little-endian unsigned 32-bit) with its place in the document."""

    doc_id: int | None
    doc_tokens: int
    start: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * at]), self._replace(start=self.start + at, ids=self.ids[4 * at :])


class Windows:
    """Open windows of one task: place() takes a piece and returns the windows that it fills, open() those that remain."""

    def __init__(self, room: int, most: int):
        self.room, self.most = room, most
        self.gaps: list[tuple[int, int]] = []  # (free places, number), by free places
        self.held: dict[int, list[Piece]] = {}
        self.next = 0

    def place(self, piece: Piece) -> list[list[Piece]]:
        full = []
        while piece.length >= self.room:
            head, piece = piece.cut(self.room)
            full.append([head])
        while piece.length:
            at = bisect_left(self.gaps, (piece.length, -1))
            if at < len(self.gaps):
                gap, own = self.gaps.pop(at)
                self.held[own].append(piece)
                left = gap - piece.length
                piece = piece.cut(piece.length)[1]
            elif len(self.gaps) < self.most:
                own, self.next = self.next, self.next + 1
                self.held[own] = [piece]
                left = self.room - piece.length
                piece = piece.cut(piece.length)[1]
            else:
                gap, own = self.gaps.pop(0)  # the fullest
                head, piece = piece.cut(gap)
                self.held[own].append(head)
                left = 0
            if left:
                insort(self.gaps, (left, own))
            else:
                full.append(self.held.pop(own))
        return full

    def open(self) -> list[list[Piece]]:
        """The open windows, the fullest first."""
        return [self.held[own] for _, own in self.gaps]


def closed_end(windows: list[list[Piece]], room: int) -> list[list[Piece]]:
    """The pieces of open windows as full windows and, for what remains, windows whose lengths are powers of two."""
    out: list[list[Piece]] = []
    rest = sum(p.length for w in windows for p in w)
    sizes = [room] * (rest // room) + [1 << k for k in range(room.bit_length(), -1, -1) if (rest % room) >> k & 1]
    pieces = [p for w in windows for p in w][::-1]
    for size in sizes:
        own: list[Piece] = []
        while size:
            piece = pieces.pop()
            if piece.length > size:
                piece, more = piece.cut(size)
                pieces.append(more)
            own.append(piece)
            size -= piece.length
        out.append(own)
    return out


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("lane", pa.int64()), ("ids", pa.binary())]
ARROW = pa.schema(FIELDS)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, lane long, ids binary"


def _columns(windows: list[list[Piece]], first_id: int, lane: int | None, with_ids: bool) -> dict[str, list]:
    """Columns of the pieces of windows; lane is null for windows that are done."""
    cols: dict[str, list] = {name: [] for name, _ in FIELDS}
    for k, window in enumerate(windows):
        offset = 0
        for p in window:
            own = (p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, first_id + k, offset, lane, p.ids if with_ids or lane is not None else None)
            for col, x in zip(cols.values(), own, strict=True):
                col.append(x)
            offset += p.length
    return cols


def _first_round(docs: DataFrame, vocabulary: dict[str, int], room: int, end_id: int, most: int, with_ids: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a tokenizer's vocabulary doesn't grow with the corpus

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lane = Encoder(shared.value), TaskContext.get().partitionId()
        end, windows, done = np.array([end_id], "<u4").tobytes(), Windows(room, most), lane << 32
        for batch in batches:
            ids = encoder.encode_all([x.as_py() or "" for x in batch.column(1)])
            full = []
            for doc_id, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                full += windows.place(Piece(doc_id, len(own) // 4 + 1, 0, own + end))
            yield pa.RecordBatch.from_pydict(_columns(full, done, None, with_ids), schema=ARROW)
            done += len(full)
        yield pa.RecordBatch.from_pydict(_columns(windows.open(), done, lane, with_ids), schema=ARROW)

    return mapped(docs, pack, PIECES)


def _merged(leftovers: DataFrame, depth: int, room: int, most: int, fan_in: int, last: bool, with_ids: bool) -> DataFrame:
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        lane, windows, full = key[0].as_py(), Windows(room, most), []
        rows = rows.sort_by([("length", "descending"), ("lane", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        for row in rows.select(["doc_id", "doc_tokens", "start", "ids"]).to_pylist():
            full += windows.place(Piece(**row))
        first = ((depth << 24) + lane) << 32
        if last:
            full += closed_end(windows.open(), room)
        tables = [_columns(full, first, None, with_ids)] + ([] if last else [_columns(windows.open(), first + len(full), lane, with_ids)])
        return pa.concat_tables([pa.Table.from_pydict(t, schema=ARROW) for t in tables])

    importable(leftovers.sparkSession)
    return leftovers.groupBy(F.expr(f"lane div {fan_in}").alias("next_lane")).applyInArrow(merge, PIECES)


def pack_windows(
    docs: DataFrame, vocabulary: dict[str, int], room: int = 2048, end_id: int = 1, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN, with_ids: bool = False
) -> DataFrame:
    """A row for every piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids). room is a power of two."""
    if room & (room - 1):
        raise ValueError("the room of a window must be a power of two")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = written(_first_round(narrow, vocabulary, room, end_id, open_windows, with_ids), "windows")
    done, depth = packed.filter("lane is null"), 0
    while True:
        left = packed.filter("lane is not null")
        lanes = left.agg(F.max("lane")).first()[0]
        if lanes is None:
            break
        depth += 1
        packed = written(_merged(left, depth, room, open_windows, fan_in, lanes < fan_in, with_ids), "windows")
        done = done.unionByName(packed.filter("lane is null"))
    contract = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return done.select(*contract, *(["ids"] if with_ids else []))
