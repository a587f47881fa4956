"""Packing tokenised documents into training sequences by the sum-of-squares rule.

A document is its token ids followed by an end id. Documents longer than a sequence are cut into pieces of
exactly one sequence each, but for the first piece, which takes the remainder. Every piece is placed where the
sum of N(g)^2 becomes smallest, N(g) being the number of open sequences with g free places: either in an open
sequence with enough room or in a new one. Pieces are dealt to groups of bounded size by a hash of their
document and number, and every group packs on its own, so that no task sees more than about
`group_pieces` pieces; within a group pieces are taken by falling length, which leaves the small ones to fill
gaps. Sequences that remain with room are offered again, as wholes, to each other by the same rule.

Defined results: a null text is empty and takes one place (the end id); texts are tokenised whole; repeated
rows are packed once each; a special token's string in a text is that token, as the tokenizers library has it; null ids are kept as null; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

#: Split pattern of byte-level BPE tokenizers (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Special tokens whose strings are looked for in texts (fixed value).
SPECIAL = ("<|endoftext|>",)
CACHE_WORDS = 400_000
_HARD = re.compile(r"\s (?!\S)")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder(dict):
    """text -> token ids as little-endian 32-bit bytes.

    The tokenizer's own split never joins what stands on both sides of a blank, except in runs of white space,
    so words with their blank are encoded once and kept; texts with such runs are encoded whole.
    """

    def __init__(self, vocabulary: dict[str, int]):
        import tiktoken

        super().__init__()
        letters = _byte_letters()
        self.special = {piece: array("I", [vocabulary[piece]]).tobytes() for piece in SPECIAL if piece in vocabulary}
        self.cut_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in self.special and all(c in letters for c in piece)}
        self.core = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.leads = np.zeros(max(ranks.values()) + 1, bool)
        self.leads[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True

    @staticmethod
    def vocabulary(path: str) -> dict[str, int]:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return data["model"]["vocab"] | {t["content"]: t["id"] for t in data["added_tokens"]}

    def ids(self, text: str) -> bytes:
        parts = self.cut_at.split(text) if self.cut_at else [text]
        return b"".join(self.special[p] if k % 2 else array("I", self.core.encode_ordinary(p)).tobytes() for k, p in enumerate(parts) if p)

    def __missing__(self, word: str) -> bytes:
        out = self.ids(" " + word)
        if len(word) <= 64:
            self[word] = out
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes new words in one call; each begins at an id whose piece begins with a blank."""
        if len(self) >= CACHE_WORDS:
            self.clear()
        new = [w for w in words.difference(self) if len(w) <= 64 and w and not w[0].isspace() and not w[-1].isspace()]
        if not new:
            return
        ids = np.array(self.core.encode_ordinary(" " + " ".join(new)), "<u4")
        starts = (np.flatnonzero(self.leads[ids]) * 4).tolist()
        data = ids.tobytes()
        self.update(zip(new, (data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)), strict=True))

    def encode_all(self, texts: list[str], chars: int = 2_000_000) -> Iterator[bytes]:
        """The ids of every text, taken some texts at a time."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < chars:
                size, to = size + len(texts[to]), to + 1
            split = [None if _HARD.search(t) or (self.cut_at and self.cut_at.search(t)) else t.split(" ") for t in texts[at:to]]
            self.learn({w for words in split if words for w in words[1:]})
            for text, words in zip(texts[at:to], split, strict=True):
                if words is None:
                    yield self.ids(text)
                else:
                    yield (self.ids(words[0]) if words[0] else b"") + b"".join([self[w] for w in words[1:]])
            at = to


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % room or min(n, room)
    return [(0, first)] + [(a, room) for a in range(first, n, room)]


def sum_of_squares(lengths: np.ndarray, room: int) -> np.ndarray:
    """Bin of every item, taken in the given order; the rule needs only the counts of open bins per gap."""
    count = np.zeros(room + 1, np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    out, bins = np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        if size >= room:
            out[k], bins = bins, bins + 1
            continue
        # moving a bin from gap g to g - size changes the sum by 2 (N(g - size) - N(g) + 1), one to gap 0 by 1 - 2 N(g)
        delta = 2 * (count[: room + 1 - size] - count[size:] + 1)
        delta[0] = 1 - 2 * count[size]
        delta[count[size:] == 0] = np.iinfo(np.int64).max
        delta[room - size] = 2 * count[room - size] + 1  # a new bin
        left = int(delta.argmin())
        gap = left + size
        if gap == room and not count[room]:
            at, bins = bins, bins + 1
        else:
            at = open_bins[gap].pop()
            count[gap] -= 1
        out[k] = at
        if left:
            open_bins[left].append(at)
            count[left] += 1
    return out


def pack(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece: longest first (equal ones in the given order), then sequences with room are merged as wholes while that saves any."""
    order = np.argsort(-lengths, kind="stable")
    where = np.empty(len(lengths), np.int64)
    where[order] = sum_of_squares(lengths[order], room)
    while True:
        fill = np.bincount(where, lengths, minlength=0).astype(np.int64)
        by_fill = np.argsort(-fill, kind="stable")
        merged = np.empty(len(fill), np.int64)
        merged[by_fill] = sum_of_squares(fill[by_fill], room)
        if merged.max(initial=-1) + 1 == len(fill):
            break
        where = merged[where]
    at = np.argsort(where, kind="stable")
    before = np.cumsum(lengths[at]) - lengths[at]
    first = np.r_[True, where[at][1:] != where[at][:-1]] if len(at) else np.zeros(0, bool)
    offset = np.empty(len(lengths), np.int64)
    offset[at] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(at)]))
    return where, offset


PIECES = "doc_id long, copy long, serial long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, vocabulary: dict[str, int], room: int, end_id: int, with_ids: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = [("doc_id", pa.int64()), ("copy", pa.int64()), ("serial", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    arrow = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        end, serial = np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            cols: list[list] = [[] for _ in arrow]
            texts = encoder.encode_all([x.as_py() or "" for x in batch.column(2)])
            for doc_id, copy, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                ids += end
                serial += 1  # tells equal rows of a task apart
                for k, (start, length) in enumerate(cut(len(ids) // 4, room)):
                    own = ids[4 * start : 4 * (start + length)]
                    for col, x in zip(cols, (doc_id, copy, serial, k, start, length, zlib.crc32(own), np.frombuffer(own, "<i4") if with_ids else None), strict=False):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return mapped(docs, pieces, PIECES + ", ids array<int>" * with_ids)


def pack_documents(
    docs: DataFrame, vocabulary: dict[str, int], room: int = 2048, end_id: int = 0, group_pieces: int = 20_000, with_ids: bool = False
) -> DataFrame:
    """A row for every piece: doc_id, copy, piece, start, length, ids_crc32, sequence_id, offset (and its ids).

    copy numbers the rows with the same doc_id where docs has a column of that name; else it is 0 for all, and
    equal rows still become separate pieces.
    """
    copy = F.col("copy").cast("long") if "copy" in docs.columns else F.lit(0).cast("long")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), copy.alias("copy"), F.col("text").cast("string").alias("text"))
    pieces = written(tokenised_pieces(narrow, vocabulary, room, end_id, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = f"{PIECES}{', ids array<int>' * with_ids}, sequence_id long, offset long"

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="group").sort_values(["doc_id", "copy", "piece", "ids_crc32", "serial"], kind="stable", ignore_index=True)
        where, offset = pack(rows["length"].to_numpy(), room)
        return rows.assign(sequence_id=where + (int(key[0]) << 32), offset=offset)

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "copy", "piece", "ids_crc32", "serial"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(place, schema).drop("serial")
