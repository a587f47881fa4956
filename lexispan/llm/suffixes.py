"""Removing byte strings of a given length that occur more than once anywhere in the corpus.

Texts are UTF-8 bytes, matches never cross documents. Each window of `length` bytes belongs to a content-defined
anchor (anchors.py), so equal windows meet under one gram wherever they are, and the corpus falls into small
independent parts. Under a gram, cells (all windows of one anchor) that are equal as a whole are counted first, by
64-bit hashes of the gram and of the cell: where a cell comes twice, all its windows do. What is left are cells that
share their gram with different ones, as at the edges of copied passages. One of each different cell is fetched; many
grams' cells are put together, windows both of whose halves come twice are cut out, and the suffix array of the cuts
(grouping.py) brings equal windows side by side, where their bytes are compared.

A gram with too many different cells for one task is made longer: half of a cell's windows reach so far to the left of
the gram, the others so far to the right, so each cell becomes two under longer grams, equal windows staying
together. Equal cells are counted again, and what is still too much under one gram is made longer again, until a
gram is a whole window. No step holds more rows than two for each cell. The ranges that a step finds are written,
so plans don't grow with the number of rounds and what a step has read is removed.

Defined results: a null or short text has no windows and keeps all its bytes; an empty text's digest is that of no
bytes; rows are told apart by doc_id and text (a 64-bit hash of both), and equal rows are copies of each other; null doc_ids are carried
through; an empty table gives an empty result; other columns pass through `drop_repeats` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, Hashes, cells, first_anchor
from .common import discard, joined_by_count, mapped, written
from .grouping import suffix_array

LENGTH = 200
#: Different cells of a gram that one task takes at most, and bytes of cells that are sorted together, about.
HOT_CELLS = 400
SHARD_BYTES = 160_000


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def anchored(texts: DataFrame, length: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("gram", pa.int64()), ("cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                found = [cells(x.as_py() or b"", length) for x in part.column(1)]
                keys = np.repeat(part.column(0).to_numpy(), [len(f[0]) for f in found])
                lo, hi, gram, cell = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(cell.view(np.int64))], schema=schema)

    return mapped(texts, run, "key long, lo int, hi int, gram long, cell long")


_CELL = "gram long, cell long, key long, lo int, hi int, single boolean, data binary, at int, width int"
_CELL_ARROW = pa.schema(
    [("gram", pa.int64()), ("cell", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]
    + [("single", pa.bool_()), ("data", pa.binary()), ("at", pa.int32()), ("width", pa.int32())]
)


def _cell_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_CELL_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _CELL_ARROW.types, strict=True)], schema=_CELL_ARROW)


def fetched(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """A row for each wanted cell with its bytes and, where it is hot, the place and width of its gram there (else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, text, out = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), []
                for c in batch.column(2)[row].as_py():
                    data = text[c["lo"] : c["hi"] + length]
                    place = (first_anchor(data, length), GRAM) if c["hot"] else (None, None)
                    out.append((c["gram"], c["cell"], key, c["lo"], c["hi"], c["single"], data, *place))
                yield _cell_batch(out)

    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "cell", "lo", "hi", "single", "hot")).alias("cells"))
    return mapped(texts.join(lists, "key").select("key", "text", "cells"), run, _CELL)


def lengthened(held: DataFrame, length: int) -> DataFrame:
    """The cells of held as one or two cells each, under grams that are longer by half of what a window leaves beside its gram."""
    hashed = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)

    def halves(key: int, lo: int, hi: int, single: bool, data: bytes, at: int, width: int) -> Iterator[tuple]:
        slack, last = length - width, hi - lo
        left = (slack + 1) // 2  # a window with so many bytes before the gram takes them into it, else those behind
        right = slack - left + 1
        for start, stop, a, b in ((0, min(last, at - left), at - left, at + width), (max(0, at - left + 1), last, at, at + width + right)):
            if start <= stop:
                own = data[start : stop + length]
                yield hashed(b"%d,%d:" % (a - at, b - a) + data[a:b]), hashed(own), key, lo + start, lo + stop, single, own, a - start, b - a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cell_batch([half for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for half in halves(*row)])

    return mapped(held.select("key", "lo", "hi", "single", "data", "at", "width"), run, _CELL)


def disentangled(held: DataFrame, length: int, hot_cells: int) -> tuple[DataFrame, DataFrame]:
    """(ranges, cells): ranges of windows found twice among hot cells, and cells under grams that are no longer hot."""
    names, ranges, cold = [f.name for f in _CELL_ARROW], [], []
    while held.limit(1).count():
        parts = written(lengthened(held.dropDuplicates(["gram", "key", "lo"]), length), "parts")
        counts = parts.groupBy("gram", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("single").alias("alone"), F.min_by(F.struct(*names[2:]), F.struct("key", "lo")).alias("one"))
        counts = written(counts, "counts")
        twice = joined_by_count(parts.select("gram", "cell", "key", "lo", "hi", "single"), counts.filter("n > 1").select("gram", "cell", "n"), ["gram", "cell"])
        ranges.append(written(twice.filter("single").select("key", "lo", "hi"), "ranges"))
        one = counts.select("gram", "cell", *[F.col(f"one.{c}") for c in names[2:]], (F.col("alone") & (F.col("n") == 1)).alias("open")).drop("single").withColumnRenamed("open", "single")
        by_gram = one.groupBy("gram").agg(F.count(F.lit(1)).alias("cells"), F.max("single").alias("any")).filter("cells > 1 and any").select("gram", "cells")
        by_gram = written(by_gram, "mixed")
        left = written(joined_by_count(one, by_gram, ["gram"], "cells"), "cells")
        discard(parts, counts, by_gram)
        cold.append(left.filter(F.col("cells") <= hot_cells).select(*names))
        held = left.filter(F.col("cells") > hot_cells).select(*names)
    none = held.filter("false")
    return reduce(DataFrame.unionByName, ranges, none.select("key", "lo", "hi")), reduce(DataFrame.unionByName, cold, none)


def repeated_windows(parts: list[bytes], windows: list[int], length: int) -> np.ndarray:
    """For the windows of all parts in turn (so many at each part's start): whether the same bytes are another one's."""
    raw = b"".join(parts)
    offsets = np.cumsum([0, *map(len, parts[:-1])])
    starts = np.concatenate([np.arange(o, o + n) for o, n in zip(offsets, windows, strict=True)])
    half = length // 2
    hashed = Hashes(raw).every(half)
    _, back, count = np.unique(hashed, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    likely = twice[starts] & twice[starts + length - half]
    out = np.zeros(len(starts), bool)
    if not likely.any():
        return out
    # cut out what likely windows cover; a suffix that runs over the end of its cut is no window's
    some = starts[likely]
    covered = np.zeros(len(raw) + 1, np.int32)
    np.add.at(covered, some, 1)
    np.add.at(covered, some + length, -1)
    kept = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
    place = np.full(len(raw), -1)
    place[kept] = np.arange(len(kept))
    cut = np.frombuffer(raw, np.uint8)[kept]
    where = np.full(len(kept), -1)
    where[place[some]] = np.flatnonzero(likely)
    order = where[np.array(suffix_array(cut.tobytes()))]
    order = order[order >= 0]
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length)
    for at in range(0, len(order) - 1, 20_000):
        some = order[at : at + 20_001]
        same = (view[starts[some[1:]]] == view[starts[some[:-1]]]).all(axis=1)
        out[some[1:][same]] = True
        out[some[:-1][same]] = True
    return out


def sorted_shards(held: DataFrame, length: int) -> DataFrame:
    """key, lo and hi of the runs of repeated windows among single cells."""
    schema = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        windows = [len(r[4]) - length + 1 for r in rows]
        flags = repeated_windows([r[4] for r in rows], windows, length)
        out = []
        for (_, key, lo, single, _), end, n in zip(rows, np.cumsum(windows), windows, strict=True):
            if single:
                marks = np.diff(np.r_[0, flags[end - n : end].astype(np.int8), 0])
                out += [(key, lo + a, lo + b - 1) for a, b in zip(np.flatnonzero(marks == 1).tolist(), np.flatnonzero(marks == -1).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:3] == rows[-1][:3]:  # the same cell, from a row that is repeated
                    continue
                if size >= SHARD_BYTES and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield solve(rows)

    dealt = held.select("gram", "key", "lo", "single", "data").repartition("gram").sortWithinPartitions("gram", "key", "lo")
    return mapped(dealt, run, "key long, lo int, hi int")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, hot_cells: int = HOT_CELLS) -> DataFrame:
    """key (of doc_id and text) and ranges of windows, each of which starts a string that also starts elsewhere."""
    texts = docs.select(_key().alias("key"), F.col("text").cast("binary").alias("text"))
    anchors = written(anchored(texts, length), "anchors")
    often = written(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "grams")
    shared = written(joined_by_count(anchors, often, ["gram"]).drop("n"), "shared")
    discard(anchors, often)
    by_cell = shared.groupBy("gram", "cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "lo", "hi")).alias("one"))
    by_cell = written(by_cell, "cells")
    whole = joined_by_count(shared, by_cell.filter("n > 1").select("gram", "cell", "n"), ["gram", "cell"])
    whole = written(whole.select("key", "lo", "hi"), "ranges")
    discard(shared)
    # a gram's cells matter where there are different ones and a single one among them
    mixed = by_cell.groupBy("gram").agg(F.count(F.lit(1)).alias("cells"), F.min("n").alias("least")).filter("cells > 1 and least = 1").drop("least")
    mixed = written(mixed, "mixed")
    wanted = joined_by_count(by_cell, mixed, ["gram"], "cells").select("gram", "cell", "one.*", (F.col("n") == 1).alias("single"), (F.col("cells") > hot_cells).alias("hot"))
    held = written(fetched(texts, wanted, length), "held")
    discard(by_cell, mixed)
    split, cold = disentangled(held.filter("at is not null"), length, hot_cells)
    sorted_ones = written(sorted_shards(held.filter("at is null").unionByName(cold), length), "ranges")
    found = whole.unionByName(split).unionByName(sorted_ones)
    # equal rows name a range once each: a set holds it once for all of them
    return found.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def spans(ranges: list | None, length: int) -> list[tuple[int, int]]:
    """Maximal stretches of bytes that the windows cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in (() if ranges is None else ranges)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in cuts:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def whole_characters(data: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cuts without the characters that they hold only a part of."""
    out = []
    for a, b in cuts:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def digest(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, ranges, strict=True):
            data = bytes(text or b"")
            cuts = spans(own, length)
            out.append((len(data), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(without(data, cuts)).hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeated_ranges(docs, length, **limits).withColumnRenamed("key", "__key")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), _key().alias("__row")).join(found, F.col("__row") == F.col("__key"), "left")
    return rows.select("doc_id", digest("text", "ranges").alias("d")).select("doc_id", "d.*")


def drop_repeats(docs: DataFrame, length: int = LENGTH, **limits) -> DataFrame:
    """docs with the repeated strings taken out of text (whole characters only) and n_chars, where it is a column, counted anew."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, ranges, strict=True):
            if text is None or own is None:
                out.append(text)
            else:
                data = text.encode()
                out.append(without(data, whole_characters(data, spans(own, length))).decode())
        return pd.Series(out, dtype=object)

    found = repeated_ranges(docs, length, **limits).withColumnsRenamed({"key": "__key", "ranges": "__ranges"})
    rows = docs.withColumn("__row", _key()).join(found, F.col("__row") == F.col("__key"), "left")
    done = rows.withColumn("text", kept("text", "__ranges"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
