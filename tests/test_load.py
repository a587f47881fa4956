"""Loads looked up in histograms against sums over tokens, for readers at random."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

from pyspark.sql import functions as F

from lexispan import plans
from lexispan.operators import load
from lexispan.operators.detectors import PROFILES

LETTERS = re.compile(r"[^\W\d_]+")


def plain_load(sentences, zipf, reader):
    """(words, rare, long, syntax, load) of sentences of words."""
    words, totals, counts = 0, dict.fromkeys(load.KINDS, Fraction(0)), Counter()
    for s in sentences:
        words += len(s)
        if len(s) > reader["max_sentence_words"]:
            counts["syntax"] += 1
            totals["syntax"] += min(Fraction(6, 10), Fraction(25, 100) + Fraction(2, 100) * (len(s) - reader["max_sentence_words"]))
        for w in s:
            z = zipf.get(w.lower(), 0)
            if 0 < z < reader["min_zipf"]:
                counts["rare"] += 1
                totals["rare"] += min(Fraction(1), Fraction(reader["min_zipf"] - z, 200) + Fraction(3, 10))
            if len(w) > reader["max_word_length"]:
                counts["long"] += 1
                totals["long"] += min(Fraction(1), Fraction(3, 10) + Fraction(len(w) - reader["max_word_length"], 10))
    total = sum(round(float(t) * reader["weights"].get(k, 1.0) * 10_000) for k, t in totals.items())
    return words, counts["rare"], counts["long"], counts["syntax"], floor(Fraction(2 * total + words, 2 * words)) / 100


def test_lookups_equal_sums_over_tokens(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 3, 5, 9, 13, 16, 22])))
    known = [word() for _ in range(120)]
    texts = [". ".join(" ".join(rng.choices(known, k=rng.choice([1, 3, 8, 20, 45]))) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rows = [(k, t, "ab"[k % 2], "x", 1) for k, t in enumerate(texts)] + [(90, None, "a", "x", 1), (91, "", "b", "x", 1), (92, " 12 ... ", "c", "x", 1), (None, "one abc", "a", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lower string, size int")
    freq = {w: rng.randint(100, 700) for w in {k.lower() for k in known}}
    zipf = spark.createDataFrame([(w, 1, z) for w, z in freq.items()], "lower string, n long, z long")
    readers = [{"profile": f"r{k}", "min_zipf": rng.randint(90, 720), "max_word_length": rng.randint(1, 25), "max_sentence_words": rng.randint(0, 50), "weights": {"rare": 0.7, "long": rng.choice([0.0, 0.5, 1.5])}} for k in range(25)]
    frame = spark.createDataFrame([(*list(r.values())[:4], r["weights"]) for r in readers], "profile string, min_zipf long, max_word_length int, max_sentence_words int, weights map<string,double>")
    sentences = lambda t: [LETTERS.findall(s) for s in re.findall(r"[^.!?\n]+[.!?]*", t or "")]
    for by in (("doc_id",), ("source",), ()):
        units = load.units(docs, by)
        assert units.filter("lower is not null").count() == sum(len(s) for r in rows for s in sentences(r[1]))
        index = load.cumulated(load.histograms(units, zipf, by, load.loosest(frame)), by)
        got = {(*(r[c] for c in by), r.profile): (r.words, r.rare, r.long, r.syntax, r.load) for r in load.loads(index, frame, by).collect()}
        groups = {}
        for r in rows:
            key = tuple({"doc_id": r[0], "source": r[2]}[c] for c in by)
            groups.setdefault(key, []).extend(sentences(r[1]))
        want = {(*key, r["profile"]): plain_load(s, freq, r) for key, s in groups.items() for r in readers if sum(map(len, s))}
        assert got == want
    index = load.cumulated(load.histograms(load.units(docs), zipf, ("doc_id",), load.loosest(frame)), ("doc_id",))
    pairs = spark.createDataFrame([(3, "r1"), (3, "r1"), (5, "r2"), (90, "r3"), (1000, "r4"), (7, "nobody")], "doc_id long, profile string")
    assert {(r.doc_id, r.profile) for r in load.loads(index, frame, ("doc_id",), pairs).collect()} == {(3, "r1"), (5, "r2")}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    rows = load.units(docs)
    zipf = load.zipf_hundredths(rows)
    readers = load.in_hundredths(spark.createDataFrame([(n, s, z, w, x) for n, s, z, w, x in PROFILES], "profile string, max_sentence_words int, min_zipf double, max_word_length int, weights map<string,double>"))
    assert zipf.count() == 0 and load.loosest(readers) == (360, 10, 14) and load.loosest(readers.limit(0)) == (0, 0, 0)
    assert load.loads(load.cumulated(load.histograms(rows, zipf, ("doc_id",), (360, 10, 14)), ("doc_id",)), readers, ("doc_id",)).count() == 0
    assert load.flagged_words(rows, zipf, readers).count() == 0


def test_frequent_words_are_few(spark):
    """Whatever the counts, at most 100,000 words can have a zipf of 4: the bound of the broadcast."""
    rows = load.zipf_hundredths(spark.range(3000).select(F.concat(F.lit("w"), F.pmod("id", F.lit(700))).alias("lower")))
    assert rows.count() == 700 and rows.filter(F.col("z") >= load.FREQUENT).count() <= 100_000
    assert {r.z for r in rows.collect()} == {round(100 * round(math.log10(n / 3000 * 1e9), 2)) for n in (4, 5)}


def test_few_groups_meet_many_readers_in_many_tasks(spark):
    docs = spark.createDataFrame([(k, "Some words of abc. And aab " * 5, "ab"[k % 2]) for k in range(6)], "doc_id long, text string, source string")
    rows = load.units(docs, ("source",))
    readers = spark.range(300).select(F.concat(F.lit("r"), "id").alias("profile"), (300 + F.col("id")).alias("min_zipf"), (F.col("id") % 5).cast("int").alias("max_word_length"), (F.col("id") % 7).cast("int").alias("max_sentence_words"), F.create_map(F.lit("rare"), F.lit(0.7)).alias("weights"))
    index = load.cumulated(load.histograms(rows, load.zipf_hundredths(rows), ("source",), load.loosest(readers)), ("source",))
    dealt = load.loads(index, readers, ("source",), few_groups=True).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in dealt}) > 8
    assert sorted(tuple(r)[:-1] for r in dealt) == sorted(map(tuple, load.loads(index, readers, ("source",)).collect()))


def test_few_readers_are_broadcast(spark):
    """A Cartesian product would make the groups anew for every part of the readers."""
    for name in ("load_by_document", "triggers_by_kind", "load_vs_quality"):
        plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan
