"""Sound codes, respellings and the choice among pronunciations, against published and written-out examples."""

import pytest
from pyspark.sql import functions as F

from lexispan.operators import pronounce, sounds, triggers

METAPHONE = {
    "metaphone": "MTFN", "thumb": "0M", "school": "SKL", "church": "XRX", "nation": "NXN", "vision": "FXN", "special": "SPXL", "science": "SNS", "edge": "EJ", "judge": "JJ", "knee": "N", "gnome": "NM", "pneumatic": "NMTK",
    "aerial": "ERL", "write": "RT", "whole": "WL", "xylophone": "SLFN", "box": "BKS", "phone": "FN", "shoe": "X", "catch": "KX", "the": "0", "comb": "KM", "sign": "SN", "light": "LT", "ghost": "KST", "bigger": "BKR", "giant": "JNT",
    "yellow": "YL", "way": "W", "quick": "KK", "brown": "BRN", "fox": "FKS", "jumped": "JMPT", "over": "OFR", "lazy": "LS", "dogs": "TKS", "success": "SKSS", "robert": "RBRT", "rupert": "RPRT", "wind": "WNT", "wined": "WNT",
    "their": "0R", "there": "0R", "scene": "SN", "witch": "WX", "which": "WX", "quiet": "KT", "quite": "KT", "eye": "EY", "aisle": "ASL", "": "", "o'hare": "OHR",
}


def test_metaphone(spark):
    rows = spark.createDataFrame([(w,) for w in [*METAPHONE, None]], "w string").select("w", sounds.metaphone(F.col("w")).alias("code")).collect()
    assert {r.w: r.code for r in rows} == METAPHONE | {None: None}


def test_words_are_coded_once(spark):
    words = spark.createDataFrame([(w,) for w in ("night", "knight", "night", "right")], "lower string").groupBy("lower").count()
    made = sounds.coded(words)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_replace" in line]  # no code is made below the grouping
    assert {r.lower: r.code for r in made.collect()} == {"night": "NT", "knight": "NT", "right": "RT"}


def test_words_that_sound_alike(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ("their", "there", "wind", "wined", "witch", "which", "house", "the", "their")], "lower string")
    assert {(r.code, r.words, r.first_word, r.last_word) for r in sounds.sound_classes(vocabulary).collect()} == {("0R", 2, "their", "there"), ("WNT", 2, "wind", "wined"), ("WX", 2, "which", "witch")}
    none = spark.createDataFrame([], "word string, other string")
    got = {(r.word, r.other): r["rank"] for r in triggers.pair_table(vocabulary.distinct(), none).filter("word < other").collect()}
    assert got == {("their", "there"): 1, ("wind", "wined"): 1, ("which", "witch"): 1}
    assert sounds.sound_classes(vocabulary.limit(0)).count() == 0


#: Pronunciations in ARPAbet, written out.
PHONES = {
    "wind": ["W IH1 N D", "W AY1 N D"], "tear": ["T EH1 R", "T IH1 R"], "read": ["R EH1 D", "R IY1 D"], "record": ["R AH0 K AO1 R D", "R EH1 K ER0 D"], "close": ["K L OW1 S", "K L OW1 Z"], "content": ["K AA1 N T EH0 N T", "K AH0 N T EH1 N T"],
    "photograph": ["F OW1 T AH0 G R AE2 F"], "enough": ["IH0 N AH1 F", "IY0 N AH1 F"], "knight": ["N AY1 T"], "jennifer": ["JH EH1 N AH0 F ER0"], "fire": ["F AY1 R"], "more": ["M AO1 R"], "ideal": ["AY0 D IY1 L"], "present": ["P R EH1 Z AH0 N T", "P R IY0 Z EH1 N T", "P ER0 Z EH1 N T"],
    "yacht": ["Y AA1 T"], "colonel": ["K ER1 N AH0 L"], "intention": ["IH2 N T EH1 N CH AH0 N"], "extra": ["EH1 K S T R AH0"], "measure": ["M EH1 ZH ER0"], "singer": ["S IH1 NG ER0"], "hmm": ["HH M"], "odd": ["AA1 D", "AO1 D"],
}


@pytest.fixture(scope="module")
def said(spark):
    rows = [(w, k, p.split()) for w, ps in PHONES.items() for k, p in enumerate(ps)]
    p = spark.createDataFrame(rows, "word string, variant int, phones array<string>").cache()
    return p, pronounce.respelled(p).cache()


def test_respellings(said):
    got = {(r.word, r.variant): r.respelling for r in said[1].collect()}
    wanted = {
        ("wind", 0): "WIND", ("wind", 1): "WYND", ("tear", 0): "TAIR", ("tear", 1): "TEER", ("read", 0): "RED", ("read", 1): "REED", ("record", 0): "ruh-KORD", ("record", 1): "REK-erd", ("photograph", 0): "FOH-tuh-graf", ("enough", 0): "ih-NUF", ("knight", 0): "NYT",
        ("jennifer", 0): "JEN-uh-fer", ("fire", 0): "FYR", ("more", 0): "MOR", ("ideal", 0): "eye-DEEL", ("yacht", 0): "YOT", ("colonel", 0): "KER-nul", ("intention", 0): "in-TEN-shun", ("extra", 0): "EK-struh", ("measure", 0): "MEZH-er", ("singer", 0): "SING-er", ("hmm", 0): "HM",
    }
    assert {k: got[k] for k in wanted} == wanted and len(got) == sum(map(len, PHONES.values()))


def test_senses_choose_their_pronunciation(spark, said):
    p, respellings = said
    senses = spark.createDataFrame([("wind", "NOUN"), ("wind", "VERB"), ("tear", "NOUN"), ("tear", "VERB"), ("read", "VERB"), ("read", "NOUN"), ("record", "NOUN"), ("record", "VERB"), ("record", "ADJ"), ("close", "VERB"), ("close", "ADJ"), ("close", "ADV"), ("close", "NOUN"),
                                    ("content", "ADJ"), ("content", "NOUN"), ("present", "VERB"), ("present", "NOUN"), ("odd", "ADJ"), ("odd", "NOUN"), ("knight", "NOUN"), ("nosuch", "NOUN")], "word string, pos string")
    routes = pronounce.sense_routes(p, senses)
    words = [("wind", "NOUN", "NN", "WIND", False), ("wind", "VERB", "VB", "WYND", False), ("tear", "VERB", "VB", "TAIR", False), ("tear", "NOUN", "NN", "TEER", False), ("read", "VERB", "VBP", "REED", False), ("read", "VERB", "VBD", "RED", False), ("read", "NOUN", "NN", "REED", False), ("read", "VERB", None, "RED", False),
             ("record", "NOUN", None, "REK-erd", False), ("record", "VERB", None, "ruh-KORD", False), ("record", "ADJ", None, "REK-erd", False), ("close", "VERB", None, "KLOHZ", False), ("close", "ADJ", None, "KLOHS", False), ("content", "ADJ", None, "kuhn-TENT", False), ("content", "NOUN", None, "KAHN-tent", False),
             ("present", "VERB", None, "pree-ZENT", False), ("present", "NOUN", None, "PREZ-uhnt", False), ("odd", "ADJ", None, "AHD", True), ("odd", "NOUN", None, "AWD", True), ("knight", "NOUN", None, "NYT", False), ("enough", "ADV", None, "ih-NUF", False), ("zzq", "NOUN", None, None, False)]
    frame = spark.createDataFrame([(k, *w[:3]) for k, w in enumerate(words)], "k int, lower string, pos string, tag string")
    got = {r.k: (r.respelling, r.ambiguous) for r in pronounce.respell(frame, respellings, routes).collect()}
    assert got == {k: w[3:] for k, w in enumerate(words)}
    noun = pronounce.respell(spark.createDataFrame([("close", "NOUN")], "lower string, pos string"), respellings, routes).first()
    assert noun.ambiguous  # no route for the noun: one of both, and said to be unsure
    aux = pronounce.respell(spark.createDataFrame([("wind", "AUX")], "lower string, pos string"), respellings, routes).first()
    assert aux.respelling == "WYND"
