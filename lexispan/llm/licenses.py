"""License notices: exact phrases at word level, and fuzzy search for short notices.

Texts are lower-cased (A-Z only) and cut into words of letters, digits and non-ASCII characters.
Exact phrases are looked up in the normalised word string. For the fuzzy notices each pattern with an
error bound of k edits is split into k + 1 pieces: a text within k edits must hold one of them unchanged
(pigeonhole), so exact seeds give all candidate places, and the regex library's bounded-error matching
verifies each place and reports its span and edits.

Defined results: a null or empty text has no words, no matches and score 0; texts are searched whole;
repeated rows give repeated results; a null doc_id is carried through; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Exact phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices for fuzzy search: label, words, allowed edits in characters (fixed values).
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", 4),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("mit", "released under the mit license", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    ("gpl", "licensed under the gnu general public license", 4),
    ("lgpl", "gnu lesser general public license", 3),
    ("mpl-2.0", "subject to the terms of the mozilla public license", 4),
    ("cc-by", "creative commons attribution", 3),
    ("cc-by-nc", "licensed under cc by nc", 1),
    ("cc-by-sa", "licensed under cc by sa", 1),
    ("cc0", "dedicated to the public domain", 3),
    ("reserved", "all rights reserved", 2),
    ("proprietary", "confidential and proprietary", 3),
)

#: Bytes that aren't part of a word become blanks; A-Z become a-z; bytes of non-ASCII characters stay.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,start_word:long,end_word:long,edits:int,matched:string>>"
)
_SPAN = pa.struct(
    [("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())]
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)


@dataclass(frozen=True)
class _Notice:
    label: str
    text: bytes
    edits: int
    seeds: tuple[tuple[int, bytes], ...]
    pattern: object


def _compiled(notices) -> list[_Notice]:
    out = []
    for label, words, edits in notices:
        text = words.encode()
        cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
        seeds = tuple((a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        # word-bounded: the match starts and ends at a blank of the normalised string
        pattern = regex.compile(rb"(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(words).encode(), edits), regex.ENHANCEMATCH)
        out.append(_Notice(label, text, edits, seeds, pattern))
    return out


def _windows(norm: bytes, notice: _Notice) -> list[tuple[int, int]]:
    """Merged stretches of norm that can hold a match, from every exact occurrence of every seed."""
    spots = []
    for offset, seed in notice.seeds:
        at = norm.find(seed)
        while at >= 0:
            start = at - offset - notice.edits - 1
            spots.append((max(0, start), min(len(norm), start + len(notice.text) + 3 * notice.edits + 2)))
            at = norm.find(seed, at + 1)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spots):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def normalised(text: bytes | None) -> bytes:
    """Words joined by single blanks, a blank on either side; b' ' without words."""
    words = (text or b"").translate(_TABLE).split()
    return b" %s " % b" ".join(words) if words else b" "


def blanks(norm: bytes) -> np.ndarray:
    """Places of the blanks of normalised words: how many lie before a place is a binary search."""
    return np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)


def exact_places(norm: bytes, phrases: dict[str, str], gaps: np.ndarray) -> list[tuple[int, str, int]]:
    """(word, label, words) of every place of a phrase."""
    found = []
    for phrase, label in phrases.items():
        needle = b" %s " % phrase.encode()
        at = norm.find(needle)
        while at >= 0:
            found.append((int(np.searchsorted(gaps, at)), label, phrase.count(" ") + 1))
            at = norm.find(needle, at + 1)
    return found


def fuzzy_spans(norm: bytes, notices: list[_Notice], gaps: np.ndarray) -> list[tuple]:
    """(label, first word, word after the last, edits, match, length) of matches from left to right.

    A match is the first within the bound, improved where it stands; the search goes on behind it."""
    found = []
    for notice in notices:
        for a, b in _windows(norm, notice):
            for m in notice.pattern.finditer(norm, a, b):
                start = int(np.searchsorted(gaps, m.start())) - 1
                words = m.group().count(b" ") + 1
                found.append((notice.label, start, start + words, sum(m.fuzzy_counts), m.group().decode(errors="replace"), len(notice.text)))
    return found


def scan_notices(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of docs: word count, exact places, labels of both kinds, best score and all fuzzy spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(notices)
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for k, doc_id in enumerate(ids):
                norm = normalised(batch.column(1)[k].as_py())
                gaps = blanks(norm)
                places = exact_places(norm, phrases, gaps)
                fuzzy = fuzzy_spans(norm, compiled, gaps)
                starts = [p[0] for p in places]
                base = sorted({p[1] for p in places})
                score = max([1.0] * bool(places) + [1 - f[3] / f[5] for f in fuzzy], default=0.0)
                rows.append(
                    (doc_id, norm.count(b" ") - 1, len(places), min(starts, default=None), max(starts, default=None))
                    + (",".join(base), ",".join(sorted({*base, *(f[0] for f in fuzzy)})), score)
                    + ([dict(zip(("label", "start_word", "end_word", "edits", "matched"), f, strict=False)) for f in fuzzy],)
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)] if rows else [pa.array([], t) for t in _ARROW.types],
                schema=_ARROW,
            )

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), scan, SCHEMA)
