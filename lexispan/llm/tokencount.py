"""Token counts under a unigram vocabulary, without building the tokens.

The best segmentation of a word is found by dynamic programming over its characters: an Aho-Corasick
automaton enumerates the vocabulary pieces that end at each character, and every position carries only the
best score and the number of pieces on that path. Ties follow the unigram tokenizers: candidates are tried by
ascending start and replace the best only if strictly better, so of equally good last pieces the longest stays.
A character that no single-character piece covers may be taken as unknown, at the lowest vocabulary score
less 10; a run of unknown characters counts its UTF-8 bytes where the vocabulary has all byte pieces, and one
piece otherwise.

Each blank becomes the mark U+2581 and a text that doesn't start with one gets one in front; pieces never
cross a mark, so that a text is the sequence of its marked words and each distinct word is solved once per
worker (a bounded cache).

Defined results: null and empty texts have 0 tokens and score 0; a text is counted whole, whatever its length;
repeated rows give repeated results; null ids are carried through; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words kept per worker; the cache is emptied beyond that.
CACHE_WORDS = 500_000


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a model file in order of their ids; scores fall with the logarithm of the id."""
    import math

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -math.log(2.0 + i)) for i in range(model.get_piece_size())]


class UnigramCounter(dict):
    """word -> (score, pieces); the word carries its mark."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown_id: int = 0):
        super().__init__()
        self.machine = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:  # as the tokenizers do, the unknown and byte pieces take part like any other
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.has_bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in vocabulary}
        self.inner_mark = any(MARK in piece[1:] for piece, _ in vocabulary if piece.strip(MARK))

    def __missing__(self, word: str) -> tuple[float, int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self.solve(word)
        if len(word) <= 64:
            self[word] = out
        return out

    def solve(self, word: str) -> tuple[float, int]:
        n = len(word)
        if self.single.issuperset(word):  # no character can be unknown: relax matches in order of their ends
            low = float("-inf")
            score, pieces = [0.0] + [low] * n, [0] * (n + 1)
            for end, (length, value) in self.machine.iter(word):
                start = end + 1 - length
                total = score[start] + value
                if total > score[end + 1]:
                    score[end + 1], pieces[end + 1] = total, pieces[start] + 1
            return score[n], pieces[n]
        ends: list[list | None] = [None] * (n + 1)
        for end, hit in self.machine.iter(word):
            at = end + 1
            if ends[at] is None:
                ends[at] = [hit]
            else:
                ends[at].append(hit)
        score, pieces, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for at in range(1, n + 1):
            best, count, run, single = None, 0, False, False
            for length, value in ends[at] or ():  # the automaton reports the longest, so the earliest start, first
                start = at - length
                total = score[start] + value
                if best is None or total > best:
                    best, count, run = total, pieces[start] + 1, False
                single = single or length == 1
            if not single:
                total = score[at - 1] + self.unknown
                if best is None or total > best:
                    cost = len(word[at - 1].encode("utf-8", "replace")) if self.has_bytes else int(not open_run[at - 1])
                    best, count, run = total, pieces[at - 1] + cost, True
            score[at], pieces[at], open_run[at] = best, count, run
        return score[n], pieces[n]

    def count(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            words.pop(0)
        if self.inner_mark:  # pieces may cross a mark: solve the whole text at once
            return self.solve(MARK + MARK.join(words))
        got = [self[MARK + w] for w in words]
        return sum(s for s, _ in got), sum(c for _, c in got)


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens and the best path's score, for each row of docs."""
    schema = pa.schema([(id_column, pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(shared.value)
        for batch in batches:
            got = [counter.count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c for _, c in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())], schema=schema
            )

    narrow = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).cast("string").alias(text_column))
    return mapped(narrow, count, f"{id_column} long, n_tokens long, score double")
