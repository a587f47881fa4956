"""Operators on small fixtures."""

from pyspark.sql import functions as F

from lexispan.functions import text as X
from lexispan.operators import detectors, protect, service, tokens
from lexispan.sources import pages
from lexispan.sources.scratch import stored
from lexispan.streaming import jobs


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first().y


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_text_units(spark):
    x = F.col("x")
    assert one(spark, "A title\n\nFirst line\nsecond. Then\n\n\nlast", X.paragraphs(x)) == ["A title", "First line\nsecond. Then", "last"]
    assert one(spark, "One. Two! Three? 4", X.sentences(x)) == ["One.", "Two!", "Three?", "4"]
    assert one(spark, None, X.sentences(x)) == []
    assert one(spark, "A short title", X.is_heading(x)) and not one(spark, "It ends.", X.is_heading(x))
    assert one(spark, "one two three", X.cut_to_quota(x, 9)) == "one two"
    assert one(spark, "a\r\nb\r\n\r\n\r\nc", X.joined_lines(x)) == "a b\n\nc"
    assert one(spark, "# Head\n**bold** `code`", X.without_markdown(x)) == "Head\nbold code"
    assert one(spark, "HARVEST", X.matched_case(F.lit("crop"), x)) == "CROP"
    assert one(spark, "Harvest", X.matched_case(F.lit("crop"), x)) == "Crop"


def test_capitals_letter_by_letter(spark):
    rows = spark.createDataFrame([("deseinßgeung", "GERÄT"), ("ßa", "Ab"), ("ﬁx", "AB"), ("éa", "AB"), ("ab", "ab")], "w string, o string")
    assert [r[0] for r in rows.select(X.matched_case(F.col("w"), F.col("o"))).collect()] == ["DESEINẞGEUNG", "ẞa", "ﬁX", "ÉA", "ab"]


def test_chunks(spark):
    text = "\n".join(" ".join(["w"] * n) for n in (3, 4, 5, 2, 9))
    rows = tokens.chunked_paragraphs(docs(spark, text, "", None), 8).orderBy("chunk").collect()
    assert [(r.doc_id, r.chunk, r.words) for r in rows] == [(0, 0, 7), (0, 1, 7), (0, 2, 9)]


def test_lookalikes(spark):
    words = spark.createDataFrame([(w,) for w in ("form", "from", "forms", "quiet", "quite", "house", "für", "fürs", "fürst")], "lower string")
    assert {(r.word, r.other) for r in detectors.lookalike_pairs(words).collect()} == {("form", "from"), ("form", "forms"), ("quiet", "quite"), ("fürs", "fürst")}


def test_lookalikes_of_one_stem_and_at_random(spark):
    """Words that differ in the letter after a common stem, and words of few letters, against the distance of every two."""
    import itertools
    import random

    rng = random.Random(2)
    words = sorted({"stemma" + a for a in "abcdefghijklmnopqrstuvwxyz"} | {"".join(rng.choices("abc", k=rng.randint(3, 6))) for _ in range(150)})

    def near(a, b):
        if len(a) == len(b):
            apart = [k for k in range(len(a)) if a[k] != b[k]]
            return len(apart) == 1 or (len(apart) == 2 and apart[1] == apart[0] + 1 and a[apart[0]] == b[apart[1]] and a[apart[1]] == b[apart[0]])
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    wanted = sorted((a, b) for a, b in itertools.combinations(words, 2) if min(len(a), len(b)) >= 4 and near(a, b))
    frame = spark.createDataFrame([(w,) for w in words], "lower string")
    assert sorted((r.word, r.other) for r in detectors.lookalike_pairs(frame).collect()) == wanted
    assert detectors.lookalike_pairs(frame.limit(0)).count() == 0


def test_near_pairs(spark):
    d = docs(spark, "The form came from the office. Nothing here. A form again.")
    words = tokens.word_table(d)
    found = detectors.near_pairs(words, spark.createDataFrame([("form", "from")], "word string, other string"))
    assert [(r.lower, r.other, r.sent_index) for r in found.collect()] == [("from", "form", 0)]


def test_hits_of_readers_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "en", "An owl. The owl saw an elk."), (2, "en", "No elk"), (None, "en", "owl owl")], "doc_id long, lang string, text string")
    own = spark.createDataFrame([("a", "owl"), ("a", "elk"), ("b", "elk"), ("c", "fox")], "reader string, lower string")
    got = detectors.personal(detectors.word_counts(tokens.word_table(detectors.by_document(docs, 3))), own)
    assert {tuple(r) for r in got.collect()} == {("a", 1, 3), ("b", 1, 1), ("a", 2, 1), ("b", 2, 1), ("a", None, 2)}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 1


def test_readers_of_equal_words_are_looked_up_once(spark):
    rows = spark.createDataFrame([(1, "en", "An owl. The owl saw an elk."), (2, "en", "No elk"), (3, "en", "fox")], "doc_id long, lang string, text string")
    own = spark.createDataFrame([("a", "owl"), ("a", "elk"), ("b", "elk"), ("c", "elk"), ("d", "elk"), ("d", "owl"), ("e", "cow")], "reader string, lower string")
    classes = stored(detectors.reader_classes(own))
    assert sorted((r.words, sorted(r.readers)) for r in classes.collect()) == [(["cow"], ["e"]), (["elk"], ["b", "c"]), (["elk", "owl"], ["a", "d"])]
    counts = detectors.word_counts(tokens.word_table(rows))
    assert sorted(detectors.personal_by_class(counts, classes).collect()) == sorted(detectors.personal(counts, own).collect())


def test_ambiguity(spark):
    words = tokens.word_table(docs(spark, "They went to wind it. Outside the wind blows."))
    assert [(r.lower, r.role, r.sent_index, r.p_sent) for r in detectors.ambiguity(words).collect()] == [("wind", "NOUN", 1, 0)]


def test_gate(spark):
    rows = [(0, "She paid 40 on time. He left.", "She paid 40. He left."), (1, "She paid 40 on time.", "She paid it on time."), (2, "A b c d e f.", ""), (3, "A b c d e f.", "A"), (4, "One.", "One two three.")]
    found = protect.reject_reasons(spark.createDataFrame(rows, "doc_id long, original string, candidate string"))
    assert {r.doc_id: r.reason for r in found.collect()} == {0: None, 1: "missing_protected_span", 2: "empty", 3: "too_short", 4: "too_long"}


def test_pages(spark):
    html = "<title>T &amp; t</title><nav><p>no</p></nav><script>var a='</p>';</script><h1>Head</h1><p>First <b>bold</b><p>Second&nbsp;one<!-- x --></p>"
    assert one(spark, html, pages.article_text(F.col("x"))) == "Head\n\nFirst bold\n\nSecond one"
    assert one(spark, html, pages.title(F.col("x"))) == "T & t"
    for url, ok in (("https://a.example.com/x", True), ("ftp://a.example.com", False), ("http://localhost/", False), ("http://10.1.2.3/", False), ("http://172.32.0.1/", True), ("http://192.168.0.1:80/", False), (None, False)):
        assert one(spark, url, pages.admissible(F.col("x"))) is ok


def test_anchors(spark):
    for value, score in ((1.0, 0.0), (0.5, 100.0), (0.75, 50.0), (0.2, 100.0)):
        assert one(spark, str(value), service.anchored_score(F.col("x").cast("double"), 1.0, 0.5)) == score


def test_streams_equal_batches(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    source = spark.readStream.schema(schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    for name, stream, batch in (("views", jobs.daily_views, service.daily_views), ("counts", jobs.sliding_counts, service.sliding_counts)):
        query = stream(source).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        columns = spark.table(name).columns
        plain = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
        expected = batch(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).select(*columns)
        assert plain(spark.table(name).collect()) == plain(expected.collect())
