"""Runs of words that repeat with a period, found by a dictionary of basic factors.

A run is a longest stretch of words whose smallest period q satisfies length >= max(min_length, times * q). The
dictionary names every factor of 1, 2, 4, ... words: two factors of a document have one name if and only if they are
equal, the name of a factor of 2m words being the pair of names of its halves. At every length m the next
occurrence of a factor within 2m words proposes its distance as a period; occurrences that follow one another at an
equal distance, from neighbouring starts, make one proposal. A proposal is extended to both sides word by word in
powers of two, by comparing names, and equal (start, period) are taken once.

Why nothing is missed and no period is a multiple: let a run have the smallest period q, and m be the power of two with
q <= m < 2q, or the largest one with 2m <= min_length if that is more. The run holds the factor at its start and
that one's copy q words on, since m + q <= length, and no copy lies nearer, for a distance d < q would be a period of
d + m >= d + q words, of which q has to be a multiple. The same argument keeps a proposed distance from being a
multiple of a smaller period.

Documents are taken together, some hundred thousand words at a time, so that the work is a few numpy passes for each
length; lengths end as soon as no factor occurs twice in a document. Memory is bounded by the longest document.

Defined results: null and blank texts have no words, no runs and an empty collapsed text; a null doc_id is kept;
repeated rows give a row each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, mapped

#: Words that are taken at once; a longer document is taken alone.
CHUNK_WORDS = 400_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def next_level(names: np.ndarray, half: int, ends: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
    """Names of the factors of twice the length: pairs of names, told apart by document where doc is given; -1 where one doesn't fit or can't occur twice."""
    out = np.full(len(names), -1, np.int32)
    at = np.flatnonzero((names >= 0) & (np.arange(len(names)) + 2 * half <= ends))
    at = at[names[at + half] >= 0]
    if not len(at):
        return out
    left, right = names[at].astype(np.int64), names[at + half].astype(np.int64)
    codes = pd.factorize(left * (int(names.max()) + 1) + right)[0]
    if doc is not None:
        codes = pd.factorize(doc[at].astype(np.int64) * (int(codes.max()) + 1) + codes)[0]
        again = np.bincount(codes)[codes] > 1
        at, codes = at[again], codes[again]
    out[at] = codes
    return out


def proposals(names: np.ndarray, length: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, distance) of the next occurrences within twice the length, one for neighbouring places with an equal distance."""
    at = np.flatnonzero(names >= 0)
    order = at[np.argsort(names[at], kind="stable")]
    apart = order[1:] - order[:-1]
    near = (names[order[1:]] == names[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (apart <= 2 * length)
    step = np.zeros(len(names), np.int64)
    step[order[:-1][near]] = apart[near]
    places = np.flatnonzero(step)
    first = np.r_[True, (places[1:] != places[:-1] + 1) | (step[places[1:]] != step[places[:-1]])] if len(places) else np.zeros(0, bool)
    return places[first], step[places[first]]


def runs_of(words: np.ndarray, sizes: np.ndarray, min_length: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of documents whose word numbers stand one after the other, sorted by start, then period; starts count from the first document."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    begins = ends - np.repeat(sizes, sizes)
    levels, length, found = [words.astype(np.int32)], 1, []
    longest = int(sizes.max(initial=0))
    while True:
        if 4 * length > min_length:
            found.append(proposals(levels[-1], length, doc))
        if 2 * length > longest:
            break
        own = next_level(levels[-1], length, ends, doc if 8 * length > min_length else None)
        levels.append(own)
        length *= 2
        if own.max(initial=-1) < 0:
            break
    start, period = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    if not len(start):
        return start, start, period
    low, to = start.copy(), start + period
    # to the right: both copies advance together as long as factors are equal
    left, right = low.copy(), to.copy()
    limit, floor = ends[start], begins[start]
    for k in range(len(levels) - 1, -1, -1):
        size, names = 1 << k, levels[k]
        while True:
            fits = np.flatnonzero(right + size <= limit)
            same = fits[(names[left[fits]] >= 0) & (names[left[fits]] == names[right[fits]])]
            if not len(same):
                break
            left[same] += size
            right[same] += size
    end = right
    left, right = low, to
    for k in range(len(levels) - 1, -1, -1):
        size, names = 1 << k, levels[k]
        while True:
            fits = np.flatnonzero(left - size >= floor)
            same = fits[(names[left[fits] - size] >= 0) & (names[left[fits] - size] == names[right[fits] - size])]
            if not len(same):
                break
            left[same] -= size
            right[same] -= size
    total = end - left
    good = total >= np.maximum(min_length, times * period)
    each = np.unique(np.stack([left[good], period[good], total[good]], axis=1), axis=0)
    return each[:, 0], each[:, 2], each[:, 1]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) == 0


def _rows(ids: list, texts: list[list[bytes]], min_length: int, times: int) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
    start, length, period = runs_of(words, sizes, min_length, times)
    first = np.cumsum(sizes) - sizes
    at = np.searchsorted(start, np.r_[first, sizes.sum()])
    collapsed = []
    for k, own in enumerate(texts):
        a, b = at[k], at[k + 1]
        if b > a:
            keep = kept_words(len(own), start[a:b] - first[k], length[a:b], period[a:b])
            own = [w for w, stays in zip(own, keep.tolist(), strict=True) if stays]
        collapsed.append(b" ".join(own).decode())
    owner = np.repeat(first, np.diff(at))
    runs = pa.StructArray.from_arrays([pa.array(start - owner), pa.array(length), pa.array(period)], fields=list(RUN))
    columns = [pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs), pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, min_length: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed, the text with one period of every run.

    Words are joined by one blank in `collapsed`. One narrow pass, no shuffle."""
    if times < 3:
        raise ValueError("a run must hold its period at least three times for the proof of completeness")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            texts: list[list[bytes]] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = (text.as_py() or "").encode().split()  # bytes split at ASCII white space alone
                if held and held + len(own) > CHUNK_WORDS:
                    yield _rows(ids, texts, min_length, times)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(own)
                held += len(own)
            if ids:
                yield _rows(ids, texts, min_length, times)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(narrow, find, SCHEMA)


def repeating_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which about a tenth of the documents (by a checksum of doc_id) repeat a stretch of words to their end.

    With h the CRC-32 of doc_id in decimals, g = h div 10 and n words: where h mod 10 = 0, word i >= a becomes word
    a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null doc_id or a text without words stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.floor(h / 10).alias("g"), F.when(hit, words).otherwise(F.array().cast("array<string>")).alias("w"))
    rows = rows.withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.pmod(F.col("g"), F.greatest(F.col("n"), F.lit(1))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(F.col("g"), F.lit(8))))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length/period (ties: smallest start, then period) and checksums of runs and collapsed text."""
    better = F.array_sort("runs", lambda x, y: F.when(x.length * y.period != y.length * x.period, F.sign(y.length * x.period - x.length * y.period)).when(x.start != y.start, F.sign(x.start - y.start)).otherwise(F.sign(x.period - y.period)).cast("int"))
    best = F.get(better, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
