"""Interval structures against plain Python, and the rules that rest on them: conflicts of substitutions, excerpts, entities, offsets of rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from lexispan.operators import edits, intervals, pronounce, protect
from lexispan.operators.token_table import completed, token_table
from lexispan.sources import documents

from .fixtures import tokens


def test_first_come_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.randrange(3), rng.randrange(9), (s := rng.randrange(60)), s + rng.randint(1, 9), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, rank int, place int, start long, end long, k int")
    taken = defaultdict(list)
    for d, rank, place, s, e, k in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[4], r[5])):
        if not any(a < e and s < b for a, b, _ in taken[d]):
            taken[d].append((s, e, k))
    got = intervals.first_come(frame, ["doc_id"], ["rank", "place"])
    assert got.columns == frame.columns
    assert {(r.doc_id, r.k) for r in got.collect()} == {(d, k) for d, own in taken.items() for _, _, k in own}
    assert intervals.first_come(frame.limit(0), ["doc_id"], ["rank"]).count() == 0


def test_islands_and_runs(spark):
    frame = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 4, 9), (1, 9, 10), (2, 0, 1), (1, 20, 30), (None, 1, 2), (None, 1, 3)], "d long, start int, end int")
    got = defaultdict(set)
    for r in intervals.islands(frame, ["d"]).collect():
        got[(r.d, r.island)].add((r.start, r.end))
    assert sorted(map(sorted, got.values())) == [[(0, 1)], [(0, 5), (3, 4), (4, 9)], [(1, 2), (1, 3)], [(9, 10)], [(20, 30)]]
    labels = spark.createDataFrame([(k, x) for k, x in enumerate("AAB-BBA")], "k int, x string").withColumn("d", F.lit(1))
    runs = intervals.runs(labels, ["d"], "k", F.nullif("x", F.lit("-")), F.col("k") == 5)
    by_run = defaultdict(list)
    for r in runs.collect():
        by_run[r.run].append(r.k)
    assert sorted(by_run.values()) == [[0, 1], [2], [4], [5], [6]]


def found(spark, rows):
    """Triggers of the fixture "wind" (Grandpa would wind up the clock.) from kind, start, end, text and alternatives."""
    made = [(0, "p", kind, 0, s, e, text, "r", 1.0, alts, 1.0, k) for k, (kind, s, e, text, alts) in enumerate(sorted(rows, key=lambda r: (r[1], -r[2])))]
    return spark.createDataFrame(made, "doc_id long, profile string, kind string, sent_index long, start long, end long, text string, reason string, score double, alternatives array<string>, weighted double, place long")


def test_a_refused_substitution_takes_nothing(spark):
    t = completed(tokens(spark, "wind").drop("dep"))
    none = spark.createDataFrame([], "doc_id long, start long, end long")
    of = lambda *rows: {(r.kind, r.text, r.replacement) for r in edits.substitutions(found(spark, rows), t, none).collect()}
    # a reader's own word on "up" beats the phrase on "wind up", and "wind" is then free for the ambiguity
    rows = (("personal", 19, 21, "up", ["high"]), ("phrasal", 14, 21, "wind up", ["end up"]), ("ambiguity", 14, 18, "wind", ["twist"]))
    assert of(*rows) == {("personal", "up", "high"), ("ambiguity", "wind", "twist")}
    assert of(*rows[1:]) == {("phrasal", "wind up", "end up")}
    assert of(rows[0], rows[1]) == {("personal", "up", "high")}
    shielded = spark.createDataFrame([(0, 19, 21)], "doc_id long, start long, end long")
    assert {r.kind for r in edits.substitutions(found(spark, rows), t, shielded).collect()} == {"ambiguity"}
    assert {r.replacement for r in edits.substitutions(found(spark, [("personal", 0, 7, "Grandpa", ["he", "x"])]), t, none).collect()} == {"He"}


def test_an_entry_that_overlaps_only_a_skipped_one_stays(spark):
    paragraphs = spark.createDataFrame([(1, 0, 0, 30, 9), (1, 1, 32, 50, 9), (1, 2, 52, 70, 9)], "doc_id long, para_no int, start int, end int, words int")
    rows = [(0, 10), (5, 12), (11, 14), (20, 20 + 5), (20, 22), (45, 52), (48, 50), (60, 62)]
    entries = spark.createDataFrame([(1, "p", s, e) for s, e in rows], "doc_id long, profile string, start int, end int")
    kept, inside = pronounce.excerpt(paragraphs, entries, 12)
    assert kept.count() == 2
    # (5, 12) is skipped, so (11, 14) stays; (45, 52) reaches beyond the excerpt
    assert sorted((r.start, r.end) for r in inside.collect()) == [(0, 10), (11, 14), (20, 22), (48, 50)]


def entity_tokens(spark, words):
    """(text, ws, pos, ent_type, iob) one after the other."""
    rows, at = [], 0
    for k, (text, ws, pos, ent, iob) in enumerate(words):
        rows.append((1, 0, 0, k, at, at + len(text), text, ws, text.lower(), text.isalpha(), False, pos, ent, iob))
        at += len(text) + len(ws)
    return spark.createDataFrame(rows, "doc_id long, para_no long, sent_index long, tok_i long, start long, end long, text string, ws string, lower string, is_alpha boolean, like_num boolean, pos string, ent_type string, ent_iob string")


def test_entities_of_several_tokens_are_one_span(spark):
    words = [("New", " ", "PROPN", "GPE", "B"), ("York", " ", "PROPN", "GPE", "I"), ("City", " ", "PROPN", "GPE", "I"), ("and", " ", "CCONJ", "", "O"), ("Rome", " ", "PROPN", "GPE", "B"),
             ("Paris", " ", "PROPN", "GPE", "B"), ("met", " ", "VERB", "", "O"), ("Ada", "", "PROPN", "", "O"), (",", " ", "PUNCT", "", "O"), ("40", " ", "NUM", "CARDINAL", "B"), ("Latin", "", "PROPN", "LANGUAGE", "B")]
    t = entity_tokens(spark, words)
    text = "".join(w + ws for w, ws, *_ in words)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = protect.spans_with_offsets(docs, t).orderBy("place").collect()
    got = [(r.why, r.span) for r in rows]
    assert got == [("gpe", "New York City"), ("gpe", "Rome"), ("gpe", "Paris"), ("proper noun", "Ada"), ("number", "40"), ("cardinal", "40"), ("proper noun", "Latin")] or got[4:6] == [("cardinal", "40"), ("number", "40")]
    assert all(text[r.start : r.end] == r.span for r in rows) and [r.place for r in rows] == list(range(7))
    without = {r.span for r in protect.entity_spans(t.drop("ent_iob")).collect()}
    assert "Rome Paris" in without
    # a candidate that loses an entity is sent back
    given = spark.createDataFrame([(1, text, text.replace("New York City", "the big old town"))], "doc_id long, original string, candidate string")
    assert protect.reject_reasons(given).first().reason is None
    assert protect.reject_reasons(given, protect.entity_spans(t)).first().reason == "missing_protected_span"


def test_rows_that_share_a_doc_id_or_have_none_do_not_mix(spark):
    texts = [(1, "Alpha beta. More of it."), (1, "Gamma delta 12 epsilon. End."), (None, "One two."), (None, "Three 4 four."), (None, None), (2, ""), (1, "Alpha beta. More of it.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for frame in (docs, docs.repartition(3)):
        whole = [t for _, t in texts if t]
        starts = [r for r in token_table(frame).filter("tok_i = 0").collect()]
        assert sorted(r.text for r in starts) == ["Alpha", "Alpha", "Gamma", "One", "Three"] and all(r.start == 0 for r in starts)
        assert all(any(t[r.start : r.end] == r.text for t in whole) for r in token_table(frame).collect())
        assert sorted((r.doc_id is None, r.start, r.span, r.place) for r in protect.spans_with_offsets(frame).collect()) == [(False, 12, "12", 0), (True, 6, "4", 0)]
    sections = spark.createDataFrame([(1, "Chapter 1\na\nChapter 2\nb"), (1, "Chapter 3\nc"), (None, "d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.chapter, r.title, r.body) for r in documents.chapters(sections).collect()) == [(0, 1, "", "d"), (1, 1, "Chapter 1", "a"), (1, 1, "Chapter 3", "c"), (1, 2, "Chapter 2", "b")]
    assert token_table(docs.limit(0)).count() == 0 and documents.chapters(docs.limit(0)).count() == 0 and protect.spans_with_offsets(docs.limit(0)).count() == 0


def test_the_last_seed_counts(spark):
    known = spark.createDataFrame([("a", "old", "x y", 2), ("z", "kept", "k", 1)], "slug string, title string, body string, words int")
    seeds = [("a", "first", "zzz zzz zzz"), ("a", "second", "b b"), ("c", "new", "")]
    got = {r.slug: (r.title, r.words) for r in documents.seeded(known, spark.createDataFrame(seeds, "slug string, title string, body string").coalesce(1)).collect()}
    assert got == {"a": ("second", 2), "z": ("kept", 1), "c": ("new", 0)}
    ordered = spark.createDataFrame([(*s, -k) for k, s in enumerate(seeds)], "slug string, title string, body string, at int")
    assert {r.slug: r.title for r in documents.seeded(known, ordered).collect()}["a"] == "first"
