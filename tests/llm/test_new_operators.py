"""Periodic runs, window packing and whitening against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexispan.llm import packing, periodic, queries, whitening, windows

SCHEMA = "doc_id long, text string, lang string, n int, w string, runs string, lane long, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def docs(spark, rows):
    """rows of (doc_id, text); the other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", 1, "w", "r", 7, "i") for i, t in rows], SCHEMA)


def plain_runs(w, min_length=24, times=3):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_length, times * q) and j > i:
                own = w[i : j + q]
                if not any(own[d:] == own[: len(own) - d] for d in range(1, q)):
                    found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    rng = random.Random(4)
    for trial in range(250):
        least, given = rng.choice([1, 3, 6, 9, 24]), []
        for _ in range(rng.randint(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 80))]
            if w and rng.random() < 0.6:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            given.append(w)
        sizes = np.array([len(w) for w in given], np.int64)
        first = np.cumsum(sizes) - sizes
        got = [x.tolist() for x in periodic.runs_of(np.array([x for w in given for x in w], np.int64), sizes, least, 3)]
        assert list(zip(*got, strict=True)) == [(s + int(first[k]), length, q) for k, w in enumerate(given) for s, length, q in plain_runs(w, least)], trial


def test_periodic_runs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcé ", k=3))
    texts = [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += ["a " * 30, "a b " * 12, "a b c\n" * 8 + "x " + "a b c\t" * 8, "  x y " * 12, None, "", " \n ", "one", ("p q r s " * 6 + "t ") * 4, "x " * 23]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0]), (None, "k l " * 15), (-5, "v " * 40), (2**60, texts[3])]
    found = periodic.digests(periodic.collapse_runs(periodic.repeating_tails(docs(spark, rows))))
    assert Counter(map(tuple, found.collect())) == Counter(plain_digest(*r) for r in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
    assert periodic.digests(periodic.collapse_runs(periodic.repeating_tails(docs(spark, [])))).count() == 0


def test_periodic_runs_of_a_very_long_text_and_of_the_smallest_tables(spark):
    long = " ".join(f"w{k}" for k in range(9000))
    frame = docs(spark, [(1, f"{long} {long} {long} end"), (2, "tick " * 50_000)])
    got = {r.doc_id: r for r in periodic.collapse_runs(frame).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 27_000, 9000)] and got[1].collapsed == f"{long} end"
    assert [tuple(r) for r in got[2].runs] == [(0, 50_000, 1)] and got[2].collapsed == "tick"
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op11_periodic_runs(spark, DATA).collect())) == Counter(plain_digest(*r) for r in given)


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(given, pieces, exact, end_id, room):
    """Every id of every document lies in one piece, sequences are gapless and end full or at a power of two."""
    ids = lambda t: [*exact.encode(t or "", add_special_tokens=False).ids, end_id]
    left = defaultdict(list)
    for i, t in given:
        left[i].append(ids(t))
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for i, copies in left.items():
        # pieces of rows with one doc_id: each start of a copy is followed by the piece that begins where it ends
        want, got = Counter(), Counter()
        for c in copies:
            want.update(range(len(c)))
        for p in by_doc.pop(i):
            assert any(p.doc_tokens == len(c) and zlib.crc32(array("I", c[p.start : p.start + p.length]).tobytes()) == p.ids_crc32 for c in copies)
            got.update(range(p.start, p.start + p.length))
        assert got == want
    assert not by_doc
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == room or at & (at - 1) == 0 and at < room
    return sequences


def test_window_packing(spark, exact):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(rng.choice([1, 5, 40, 200, 900]))) for _ in range(150)]
    given = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, None), (7, ""), (900, " "), (901, "<|endoftext|> a")]
    vocabulary = packing.Encoder.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    for parts, most, fan_in, room in ((1, 64, 16, 256), (7, 3, 2, 256), (7, 4, 3, 2048)):
        pieces = windows.pack_windows(docs(spark, given).repartition(parts), vocabulary, room=room, end_id=1, open_windows=most, fan_in=fan_in, with_ids=True).collect()
        sequences = check_pieces(given, pieces, exact, 1, room)
        assert sum(sum(n for _, n in own) < room for own in sequences.values()) <= room.bit_length()
        assert all(len(p.ids) == 4 * p.length for p in pieces)
    assert windows.pack_windows(docs(spark, []), vocabulary).count() == 0
    with pytest.raises(ValueError):
        windows.pack_windows(docs(spark, given), vocabulary, room=1000)


def test_window_packing_of_the_smallest_tables(spark, exact):
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(given, queries.op12_window_packing(spark, DATA).collect(), exact, 1, 2048)


def test_windows_place_best_fit_and_emit_the_fullest():
    rng = random.Random(2)
    w, most, room = windows.Windows(64, 4), 4, 64
    gaps: list[int] = []
    for k in range(3000):
        size = rng.randint(1, 63)
        full = w.place(windows.Piece(k, size, 0, bytes(4 * size)))
        emitted = 0
        while size:
            fitting = [g for g in gaps if g >= size]
            if fitting:
                gaps.remove(min(fitting))
                rest, size = min(fitting) - size, 0
            elif len(gaps) < most:
                rest, size = room - size, 0
            else:
                gaps.sort()
                size -= gaps.pop(0)
                rest = 0
            emitted += rest == 0
            gaps += [rest] * (rest > 0)
        assert len(full) == emitted and all(sum(p.length for p in own) == room for own in full)
        assert sorted(gaps) == [g for g, _ in w.gaps] and len(gaps) <= most


VECTORS = "vec_id long, embedding array<float>, x string, n int, i int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3, 4) for i, v in rows], VECTORS)


def check_whitening(given, got, components=4):
    """Against numpy's eigenvectors on the distinct vectors."""
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in whole}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, rows = np.linalg.eigh(covariance)
    values, rows = values[::-1][:components], rows.T[::-1][:components]
    out = defaultdict(dict)
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / covariance.trace()) <= 1e-9 and r.identity_error <= 1e-9
        out[(r.vec_id, r.deviation)].setdefault(r.component, []).append(r.whitened)
    want = defaultdict(list)
    for i, x in whole:
        want[(i, sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True)))].append((np.array(x) - sums / n) @ rows.T / np.sqrt(values))
    assert set(out) == set(want)
    signs = None
    for key, own in want.items():
        assert all(len(out[key][c + 1]) == len(own) for c in range(components))
        mine = np.array([[out[key][c + 1][k] for c in range(components)] for k in range(len(own))])
        ratio = mine[0] / own[0]
        signs = np.sign(ratio) if signs is None else signs
        assert np.allclose(np.sort(mine * signs, axis=0), np.sort(np.array(own), axis=0), rtol=0, atol=1e-8)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.geomspace(3, 0.05, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 40
    rows = [(i, v) for i, v in enumerate(base.tolist())] + [(1000 + i, base[7].tolist()) for i in range(400)]
    odd = [(2000, None), (2001, [None] + [1.0] * 11), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [])]
    again = [(5, base[5].tolist()), (5, base[6].tolist()), (None, base[8].tolist())]
    got = whitening.whiten(vectors(spark, [*rows, *odd, *again]).repartition(7)).collect()
    assert not {r.vec_id for r in got} & {2000, 2001, 2002, 2003, 2004} and len(got) == 4 * 703
    check_whitening([*rows, *again], got)


def test_whitening_of_few_vectors(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    got = whitening.whiten(vectors(spark, line)).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)
    check_whitening(line, got, 1)
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    mixed = whitening.whiten(vectors(spark, [*line, (9, [1.0]), (10, [1.0, 2.0])]))
    assert {r.vec_id for r in mixed.collect()} == set(range(6))


def test_whitening_of_the_smallest_tables(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(given, queries.op13_embedding_whitening(spark, DATA).collect())


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (5, 3), (16, 16), (33, 20)):
        b = rng.normal(size=(d, rank)) * np.geomspace(1, 1e-4, rank)
        a = b @ b.T
        low, order = whitening.pivoted_cholesky(a)
        assert low.shape[1] == rank and np.allclose(low @ low.T, a[order][:, order], atol=1e-13)
        assert np.all(np.triu(low, 1) == 0)
        values, rows = whitening.components_of(a)
        assert np.allclose(rows @ rows.T, np.eye(rank), atol=1e-13) and np.all(np.diff(values) <= 0)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9, atol=1e-14)
    assert whitening.components_of(np.zeros((3, 3)))[1].shape == (0, 3)


def test_sums_are_exact_and_wide_ones_refused(spark):
    wide = spark.createDataFrame([([2**40 + k, -(2**41) - k],) for k in range(50)], "x array<long>")
    n, sums = whitening.sums_of(wide)
    assert (n, sums) == (50, [50 * 2**40 + 1225, -50 * 2**41 - 1225])
    with pytest.raises(OverflowError):
        whitening._deviations(np.array([[2**40]]), whitening.Fit(2**20, [0], 1.0, np.ones(1), np.ones((1, 1))))
    big = whitening._deviations(np.array([[3, 2**31]]), whitening.Fit(1, [1, 2**31 - 5], 1.0, np.ones(1), np.ones((1, 2))))
    assert big == [29]
