"""Respellings from a table of pronunciations, and phonetic maps of texts.

pronunciations has word, variant (0 for the first) and phones (ARPAbet with stress digits). Respelling is done once for
every distinct word and variant; texts only ever join the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import first_come

#: Letters for sounds (fixed values); AH is "uh" without stress and "u" with it.
VOWELS = {"AA": "ah", "AE": "a", "AO": "aw", "AW": "ow", "AY": "y", "EH": "e", "ER": "er", "EY": "ay", "IH": "i", "IY": "ee", "OW": "oh", "OY": "oy", "UH": "uu", "UW": "oo"}
CONSONANTS = {"B": "b", "CH": "ch", "D": "d", "DH": "th", "F": "f", "G": "g", "HH": "h", "JH": "j", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ng", "P": "p", "R": "r", "S": "s", "SH": "sh", "T": "t", "TH": "th", "V": "v", "W": "w", "Y": "y", "Z": "z", "ZH": "zh"}
#: Letters for a vowel with the r after it in its syllable, and for vowels that are a syllable by themselves (fixed values).
BEFORE_R = {"AA": "ar", "AE": "air", "AH": "er", "AO": "or", "AW": "owr", "AY": "yr", "EH": "air", "EY": "air", "IH": "eer", "IY": "eer", "OW": "or", "OY": "oyr", "UH": "oor", "UW": "oor"}
BARE = {"IH": "ih", "AY": "eye", "EH": "eh", "UH": "uh"}
LAX = ("AE", "EH", "IH", "AH", "UH")
#: Clusters that may begin a syllable (fixed values); of single consonants NG and ZH may not.
ONSETS = (
    "P R", "B R", "T R", "D R", "K R", "G R", "F R", "TH R", "SH R", "P L", "B L", "K L", "G L", "F L", "S L", "T W", "D W", "G W", "K W", "S W", "S M", "S N", "S P", "S T", "S K", "S F",
    "P Y", "B Y", "T Y", "D Y", "K Y", "G Y", "M Y", "N Y", "F Y", "V Y", "HH Y", "L Y", "S P R", "S T R", "S K R", "S P L", "S K W",
)
NO_ONSET = ("NG", "ZH")
#: Respellings of words whose sounds say too little (fixed values).
IRREGULAR = {"yacht": "YOT", "colonel": "KER-nul", "intention": "in-TEN-shun"}
#: Words whose noun has its stress early and whose verb late; an adjective goes with the noun where there is a verb, else it is the late one (fixed values).
STRESS_SHIFT = ("record", "present", "object", "produce", "permit", "contract", "conduct", "project", "subject", "refuse", "desert", "content", "minute")
#: Which variant a part of speech has: one that contains a sound, or ends with it (fixed values). The tag tells the two of "read".
ROUTES = (
    ("wind", "NOUN", "contains", "IH"), ("wind", "VERB", "contains", "AY"), ("tear", "VERB", "contains", "EH"), ("tear", "NOUN", "contains", "IH"), ("lead", "VERB", "contains", "IY"), ("lead", "NOUN", "contains", "EH"),
    ("live", "VERB", "contains", "IH"), ("live", "ADJ", "contains", "AY"), ("bow", "VERB", "contains", "AW"), ("bow", "NOUN", "contains", "OW"), ("close", "VERB", "ends", "Z"), ("close", "ADJ", "ends", "S"), ("close", "ADV", "ends", "S"),
    ("dove", "VERB", "contains", "OW"), ("dove", "NOUN", "contains", "AH"), ("sow", "VERB", "contains", "OW"), ("sow", "NOUN", "contains", "AW"), ("wound", "VERB", "contains", "AW"), ("wound", "NOUN", "contains", "UW"),
    ("use", "VERB", "ends", "Z"), ("use", "NOUN", "ends", "S"), ("excuse", "VERB", "ends", "Z"), ("excuse", "NOUN", "ends", "S"),
)
TAG_ROUTES = (("read", "past", "EH"), ("read", "base", "IY"), ("read", "noun", "IY"), ("read", "else", "EH"))


def _mapped(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def respelled(pronunciations: DataFrame) -> DataFrame:
    """word, variant and respelling: syllables joined by hyphens, the stressed one in capitals, or the only one.

    Consonants between vowels go to the next syllable as far as they may begin one, but one stays to close a stressed lax vowel. Syllables are spelled
    in a second pass, once their consonants are known: a vowel joins the r after it, one that stands alone is written out, and AH goes by its stress. Irregular
    words have their own spelling; a word without a vowel is one syllable; null or empty phones give no row."""
    consonants = _mapped(CONSONANTS)
    sounds = pronunciations.select("word", "variant", F.posexplode("phones").alias("i", "p"))
    sounds = sounds.select("word", "variant", "i", F.regexp_replace("p", "[0-9]", "").alias("sound"), F.regexp_extract("p", "([0-9])", 1).alias("stress"))
    sounds = sounds.withColumn("is_vowel", F.col("stress") != "")
    order = Window.partitionBy("word", "variant").orderBy("i")
    sounds = sounds.withColumns({"v": F.sum(F.col("is_vowel").cast("int")).over(order), "all": F.sum(F.col("is_vowel").cast("int")).over(Window.partitionBy("word", "variant"))})
    # the consonants after vowel v are a cluster; so many of its last sounds begin the next syllable
    cluster = sounds.groupBy("word", "variant", "v").agg(F.max("all").alias("all"), F.array_sort(F.collect_list(F.struct("i", "sound", "is_vowel", "stress"))).alias("s"))
    names = F.transform(F.filter("s", lambda x: ~x.is_vowel), lambda x: x.sound)
    n = F.size(names)
    tail = lambda k: F.array_join(F.slice(names, n - k + 1, k), " ")
    begins = F.when((n >= 3) & tail(F.lit(3)).isin(*ONSETS), 3).when((n >= 2) & tail(F.lit(2)).isin(*ONSETS), 2).when((n >= 1) & ~F.element_at(F.concat(F.array(F.lit("NG")), names), -1).isin(*NO_ONSET), 1).otherwise(0)
    head = F.get(F.filter("s", lambda x: x.is_vowel), F.lit(0))
    closing = F.coalesce((head.stress == "1") & head.sound.isin(*LAX) & (begins == n) & (n > 0), F.lit(False))
    ahead = F.when(F.col("v") == F.col("all"), 0).when(F.col("v") == 0, n).otherwise(begins - closing.cast("int"))
    cluster = cluster.withColumn("ahead", ahead).withColumn("n", F.size("s"))
    each = cluster.select("word", "variant", "v", "all", "ahead", "n", F.posexplode("s").alias("k", "x"))
    syllable = F.when(F.col("k") >= F.col("n") - F.col("ahead"), F.col("v") + 1).otherwise(F.col("v"))
    parts = each.groupBy("word", "variant", F.greatest(syllable, F.lit(1)).alias("syllable")).agg(F.array_sort(F.collect_list("x")).alias("s"), F.max("all").alias("all"))
    vowel = F.get(F.filter("s", lambda x: x.is_vowel), F.lit(0))
    at = F.array_position(F.transform("s", lambda x: x.is_vowel), True).cast("int")
    spelled = lambda xs: F.array_join(F.transform(xs, lambda x: F.coalesce(F.try_element_at(consonants, x.sound), F.lower(x.sound))), "")
    coda = F.slice("s", at + 1, F.size("s"))
    with_r = F.when((F.get(coda, F.lit(0)).sound == "R") & (vowel.sound != "ER"), F.try_element_at(_mapped(BEFORE_R), vowel.sound))
    bare = F.when(F.size("s") == 1, F.try_element_at(_mapped(BARE), vowel.sound))
    plain = F.coalesce(F.when(vowel.sound == "AH", F.when(vowel.stress == "0", "uh").otherwise("u")), bare, F.try_element_at(_mapped(VOWELS), vowel.sound), F.lower(vowel.sound))
    text = F.when(at == 0, spelled(F.col("s"))).otherwise(F.concat(spelled(F.slice("s", F.lit(1), at - 1)), F.coalesce(with_r, plain), spelled(F.when(with_r.isNotNull(), F.slice(coda, F.lit(2), F.size("s"))).otherwise(coda))))
    said = F.when((F.col("all") <= 1) | F.coalesce(vowel.stress == "1", F.lit(False)), F.upper(text)).otherwise(text)
    out = parts.select("word", "variant", "syllable", said.alias("t")).groupBy("word", "variant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("syllable", "t"))), lambda x: x.t), "-").alias("r"))
    return out.select("word", "variant", F.coalesce(F.try_element_at(_mapped(IRREGULAR), F.col("word")), F.col("r")).alias("respelling"))


def tag_class(pos: Column, tag: Column) -> Column:
    """What a finer tag says of a verb: past, base, or noun and else by part of speech."""
    return F.when(tag.isin("VBD", "VBN"), "past").when(tag.isin("VB", "VBP", "VBZ", "VBG"), "base").when(pos == "NOUN", "noun").otherwise("else")


def sense_routes(pronunciations: DataFrame, senses: DataFrame) -> DataFrame:
    """word, pos, by_tag, variant and ambiguous for every part of speech of the lexicon's words (senses: word, pos) that have pronunciations.

    Of several variants one is chosen by a sound that it contains or ends with, by the place of its stress, or, for words whose tag
    tells, by tag (by_tag: past, base, noun or else; null elsewhere). A word without such a route, or whose route fits no variant, deals
    its variants to its parts of speech in order and is ambiguous. Of variants that fit equally the first counts."""
    spark = pronunciations.sparkSession
    bare = F.transform("phones", lambda p: F.regexp_replace(p, "[0-9]", ""))
    nuclei = F.transform(F.filter("phones", lambda p: p.rlike("[0-9]$")), lambda p: F.substring(p, -1, 1))
    place = lambda digit: F.array_position(nuclei, digit)
    stress = F.when(place("1") > 0, place("1") - 1).when(place("2") > 0, place("2") - 1).otherwise(F.lit(0))
    known = pronunciations.select("word", "variant", bare.alias("bare"), stress.cast("int").alias("stress"))
    counts = known.groupBy("word").agg(F.count(F.lit(1)).alias("variants"))
    keyed = senses.select("word", "pos").distinct()
    keyed = keyed.withColumns({"at": F.row_number().over(Window.partitionBy("word").orderBy("pos")) - 1, "has_verb": F.max((F.col("pos") == "VERB").cast("int")).over(Window.partitionBy("word"))})
    tags = F.broadcast(spark.createDataFrame(list(TAG_ROUTES), "word string, by_tag string, tag_sound string"))
    rows = keyed.join(counts, "word").join(tags, "word", "left")
    routes = F.broadcast(spark.createDataFrame(list(ROUTES), "word string, pos string, how string, sound string"))
    rows = rows.join(routes, ["word", "pos"], "left")
    shifts = F.col("word").isin(*STRESS_SHIFT)
    late = F.when(F.col("pos") == "ADJ", F.col("has_verb") == 0).otherwise(F.col("pos") == "VERB")
    # every variant of the word is weighed: the least of (doesn't fit, stress, number) is the one
    each = rows.join(known, "word")
    fits = F.when(F.col("by_tag").isNotNull(), F.array_contains("bare", F.col("tag_sound"))).when(F.col("how") == "contains", F.array_contains("bare", F.col("sound"))).when(F.col("how") == "ends", F.element_at("bare", -1) == F.col("sound")).otherwise(shifts)
    weight = F.struct((~F.coalesce(fits, F.lit(False))).alias("off"), F.when(shifts, F.when(late, -F.col("stress")).otherwise(F.col("stress"))).otherwise(0).alias("stress"), F.col("variant").alias("variant"))
    best = each.groupBy("word", "pos", "by_tag", "at", "variants").agg(F.min(weight).alias("b"), F.array_sort(F.collect_list("variant")).alias("vs"))
    dealt = F.get("vs", F.pmod(F.col("at"), F.col("variants")).cast("int"))
    routed = (F.col("variants") == 1) | ~F.col("b.off")
    return best.select("word", "pos", "by_tag", F.when(routed, F.col("b.variant")).otherwise(F.when(F.col("by_tag").isNotNull(), F.get("vs", F.lit(0))).otherwise(dealt)).alias("variant"), (~routed).alias("ambiguous"))


def respell(words: DataFrame, respellings: DataFrame, routes: DataFrame) -> DataFrame:
    """words (lower, pos, and tag where it is known) with respelling and ambiguous: by part of speech and tag, else the first variant; null where the word is unknown."""
    tag = F.col("tag") if "tag" in words.columns else F.lit(None).cast("string")
    said = routes.join(respellings, ["word", "variant"]).select(F.col("word").alias("lower"), F.col("pos").alias("r_pos"), F.col("by_tag"), F.col("respelling").alias("by_sense"), F.col("ambiguous").alias("by_sense_ambiguous"))
    first = respellings.groupBy("word").agg(F.min_by("respelling", "variant").alias("first")).withColumnRenamed("word", "lower")
    keyed = words.withColumns({"r_pos": F.when(F.col("pos") == "AUX", "VERB").otherwise(F.col("pos")), "r_tag": tag_class(F.col("pos"), tag)})
    by_tag = said.filter("by_tag is not null").select("lower", "r_pos", F.col("by_tag").alias("r_tag"), F.col("by_sense").alias("t_sense"), F.col("by_sense_ambiguous").alias("t_ambiguous"))
    by_pos = said.filter("by_tag is null").drop("by_tag")
    out = keyed.join(by_tag, ["lower", "r_pos", "r_tag"], "left").join(by_pos, ["lower", "r_pos"], "left").join(first, "lower", "left")
    out = out.withColumns({"respelling": F.coalesce("t_sense", "by_sense", "first"), "ambiguous": F.coalesce("t_ambiguous", "by_sense_ambiguous", F.lit(False))})
    return out.drop("r_pos", "r_tag", "t_sense", "t_ambiguous", "by_sense", "by_sense_ambiguous", "first")


def phonetic_map(found: DataFrame, profiles: DataFrame, respellings: DataFrame, routes: DataFrame) -> DataFrame:
    """doc_id, profile, start, end, text, kind, respelling and always, one entry for a span: the first trigger of a wanted kind there.

    Words that the reader named as triggers are wanted and shown always, whatever the kinds; safe words never; profiles whose map is off have no entry."""
    wanted = profiles.select("profile", "phonetic_map", "phonetic_map_kinds", "phonetic_map_always_kinds", F.transform("safe_words", F.lower).alias("safe"), F.transform("trigger_words", F.lower).alias("named"))
    rows = found.join(F.broadcast(wanted), "profile").filter("phonetic_map != 'off'").withColumn("lower", F.lower("text"))
    rows = rows.withColumn("own", (F.col("kind") == "personal") & F.array_contains("named", F.col("lower"))).filter((F.array_contains("phonetic_map_kinds", F.col("kind")) | F.col("own")) & ~F.array_contains("safe", F.col("lower")))
    said = respell(rows, respellings, routes).filter("respelling is not null")
    first = F.row_number().over(Window.partitionBy("doc_id", "profile", "start", "end").orderBy("place"))
    said = said.withColumn("n", first).filter("n = 1")
    return said.select("doc_id", "profile", "start", "end", "text", "kind", "respelling", ((F.col("phonetic_map") == "always") | F.array_contains("phonetic_map_always_kinds", F.col("kind")) | F.col("own")).alias("always"))


def excerpt(paragraphs: DataFrame, entries: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, entries): whole paragraphs (doc_id, para_no, start, end, words) until so many words, and the entries inside that overlap no earlier one that is kept itself."""
    before = F.sum("words").over(Window.partitionBy("doc_id").orderBy("para_no")) - F.col("words")
    kept = paragraphs.withColumn("before", before).filter(F.col("before") < words).drop("before")
    ends = kept.groupBy("doc_id").agg(F.max("end").alias("limit"))
    inside = entries.join(ends, "doc_id").filter(F.col("end") <= F.col("limit")).drop("limit")
    return kept, first_come(inside, ["doc_id", "profile"], ["start"])
