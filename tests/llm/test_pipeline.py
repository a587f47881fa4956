"""The pipeline's stages: on the smallest tables against what they may do, and on a small fixture against plain Python."""

import random
import zlib
from array import array
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lexispan.llm import packing
from lexispan.llm.common import written

from .test_operators import WORD, docs, words_of

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DATA), name)
        now = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        assert now <= ids and now
        if name != "sequence_packing":
            assert out.columns == columns and out.schema == docs.schema
        if name == "repeated_strings":
            assert now == ids and out.count() == docs.count()
        docs, ids = out, now


def fixture():
    rng = random.Random(41)
    clean = [words_of(rng, rng.randint(60, 160)) for _ in range(24)]
    passage = words_of(rng, 60)
    near = clean[0].split()
    near[70 % len(near)] = "changed"
    texts = [*clean, clean[1], " ".join(near), f"{clean[2]} {passage} é", f"{passage} {clean[3]}", None, "", "too short", "#$% " * 150, "same words again and again " * 60]
    return [(i, t, "en", ("a", "b", None)[i % 3]) for i, t in enumerate(texts)] + [(4, clean[4], "en", "b"), (None, clean[5] + " more", "en", "a")]


def shingles(text, k):
    w = WORD.findall((text or "").lower())
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def without_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for text, b in zip(texts, data, strict=True):
        marks = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                marks[i : i + length] = b"\1" * length
        kept, at = [], 0
        for c in text or "":
            size = len(c.encode())
            if not all(marks[at : at + size]):  # only whole characters go
                kept.append(c)
            at += size
        out.append(None if text is None else "".join(kept))
    return out


def test_stages_against_plain_python(spark):
    stages = dict(corpus_pipeline.STAGES)
    start = docs(spark, fixture())
    rows = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)

    good = written(stages["quality_rules"](spark, start, DATA), "good")
    bad = {None, "", "too short", "#$% " * 150, "same words again and again " * 60}
    assert rows(good) == sorted(((i, t, s) for i, t, _, s in fixture() if t not in bad), key=str)

    single = written(stages["near_duplicates"](spark, good, DATA), "single")
    given = sorted(rows(good), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    names = list(range(len(given)))
    sets = [shingles(t, 5) for _, t, _ in given]
    for i in range(len(given)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = names[i], names[j]
                names = [min(a, b) if x in (a, b) else x for x in names]
    assert [(r[0], r[1]) for r in rows(single)] == sorted(((given[k][0], given[k][1]) for k in set(names)), key=str)
    assert single.count() < good.count()

    cut = written(stages["repeated_strings"](spark, single, DATA), "cut")
    before = rows(single)
    wanted = without_repeats([t for _, t, _ in before])
    assert rows(cut) == sorted(((i, t, s) for (i, _, s), t in zip(before, wanted, strict=True)), key=str)
    assert any(len(t) < len(b[1]) for b, t in zip(before, wanted, strict=True))

    mixed = written(stages["source_mixing"](spark, cut, DATA), "mixed")
    size, copies = Counter(), Counter(rows(mixed))
    for _, t, s in rows(cut):
        size[s] += len(WORD.findall(t or ""))
    weight, goals, free = dict(zip(("a", "b", None), (3, 1, 2), strict=True)), {}, set(size)
    while free:
        left = 1.5 * sum(size.values()) - sum(goals.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        for s in over or list(free):
            goals[s] = 2.0 * size[s] if over else left * weight[s] / sum(weight[x] for x in free)
        free -= set(over or free)
    taken = Counter()
    for (_, t, s), n in copies.items():
        taken[s] += n * len(WORD.findall(t or ""))
    assert set(copies) <= set(rows(cut)) and max(copies.values()) <= 2
    assert all(abs(taken[s] - goals[s]) <= 160 for s in goals)

    packed = stages["sequence_packing"](spark, mixed, DATA).collect()
    exact, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t, _ in rows(mixed):
        ids = array("I", [*exact.encode(t or "", add_special_tokens=False).ids, 0])
        for k, (a, n) in enumerate(packing.cut(len(ids), 2048)):
            expected[(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1
