"""Sound codes of words: Metaphone by its published rules, letter by letter with the letters around it, for distinct words.

A code has 0 for th and X for sh; vowels stand only at the beginning. Null words have a null code, words without letters a to z an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginnings whose first letter is silent or read as another (fixed values).
BEGINNINGS = (("^ae", "e"), ("^[gkp]n", "n"), ("^wr", "r"), ("^wh", "w"), ("^x", "s"))
#: Letters that always have one code (fixed values).
PLAIN = {"f": "F", "j": "J", "l": "L", "m": "M", "n": "N", "q": "K", "r": "R", "v": "F", "x": "KS", "z": "S"}
VOWELS, SOFT, AFTER_H = tuple("aeiou"), tuple("eiy"), tuple("csptg")


def _code(padded: Column, i: Column) -> Column:
    """What the letter at place i says; two marks stand before a word and four after it."""
    at = lambda k: F.substring(padded, i + k, F.lit(1))
    c, before, after, next_but_one = at(0), at(-1), at(1), at(2)
    ends = lambda tail: F.substring(padded, i + 1, F.lit(len(tail) + 1)) == tail + "$"
    rules = {
        "b": F.when((before == "m") & (after == "$"), "").otherwise("B"),
        "c": F.when((after == "i") & (next_but_one == "a"), "X").when(after == "h", F.when(before == "s", "K").otherwise("X")).when(after.isin(*SOFT), F.when(before == "s", "").otherwise("S")).otherwise("K"),
        "d": F.when((after == "g") & next_but_one.isin(*SOFT), "J").otherwise("T"),
        "g": F.when(after == "h", F.when(next_but_one.isin(*VOWELS, "$"), "K").otherwise("")).when(ends("n") | ends("ned") | ((before == "d") & after.isin(*SOFT)), "").when(after.isin(*SOFT), "J").otherwise("K"),
        "h": F.when(before.isin(*AFTER_H) | (before.isin(*VOWELS) & ~after.isin(*VOWELS)), "").otherwise("H"),
        "k": F.when(before == "c", "").otherwise("K"),
        "p": F.when(after == "h", "F").otherwise("P"),
        "s": F.when((after == "h") | ((after == "i") & next_but_one.isin("o", "a")), "X").otherwise("S"),
        "t": F.when((after == "i") & next_but_one.isin("a", "o"), "X").when(after == "h", "0").when((after == "c") & (next_but_one == "h"), "").otherwise("T"),
        "w": F.when(after.isin(*VOWELS), "W").otherwise(""),
        "y": F.when(after.isin(*VOWELS), "Y").otherwise(""),
    } | {letter: F.lit(x) for letter, x in PLAIN.items()}
    out = F.when((c == before) & (c != "c"), "").when(c.isin(*VOWELS), F.when(i == 3, F.upper(c)).otherwise(""))
    for letter, rule in rules.items():
        out = out.when(c == letter, rule)
    return out


def metaphone(word: Column) -> Column:
    """The Metaphone code of a word in small letters."""
    own = F.regexp_replace(word, "[^a-z]", "")
    for pattern, put in BEGINNINGS:
        own = F.regexp_replace(own, pattern, put)
    # the array of one binds the padded word, which is then made once and not for every letter
    whole = lambda p: F.when(F.length(p) > 6, F.array_join(F.transform(F.sequence(F.lit(3), F.length(p) - 4), lambda i: _code(p, i)), "")).otherwise("")
    return F.when(word.isNotNull(), F.get(F.transform(F.array(F.concat(F.lit("^^"), own, F.lit("$$$$"))), whole), F.lit(0)))


def coded(vocabulary: DataFrame) -> DataFrame:
    """lower and code of distinct words of 4 letters or more that have a code."""
    rows = vocabulary.select("lower").filter(F.length("lower") >= 4).distinct()
    # a vocabulary is small in bytes, but each word takes time: as many tasks as there are cores, whatever the bytes
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "lower")
    # exploded, since a filter on a plain column would move below the grouping of words and code every token of the corpus
    return rows.select("lower", F.explode(F.array(metaphone(F.col("lower")))).alias("code")).filter("code != ''")


def sound_classes(vocabulary: DataFrame) -> DataFrame:
    """code, words, first_word and last_word of codes that several words share; members sound alike, and pairs aren't spelled out."""
    out = coded(vocabulary).groupBy("code").agg(F.count(F.lit(1)).alias("words"), F.min("lower").alias("first_word"), F.max("lower").alias("last_word"))
    return out.filter("words > 1")
