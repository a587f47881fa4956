"""Token tables and frequency jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.functions import text as X


def sentence_table(docs: DataFrame) -> DataFrame:
    """doc_id, lang, sent_index and sentence; documents without sentences have no row."""
    return docs.select("doc_id", "lang", F.posexplode(X.sentences(F.col("text"))).alias("sent_index", "sentence"))


def word_table(docs: DataFrame) -> DataFrame:
    """doc_id, lang, sent_index, tok_i (its place in the sentence), word and lower: words of letters, no shuffle."""
    words = F.posexplode(X.found(F.col("sentence"), X.LETTERS)).alias("tok_i", "word")
    return sentence_table(docs).select("doc_id", "lang", "sent_index", words).withColumn("lower", F.lower("word"))


def zipf_table(words: DataFrame) -> DataFrame:
    """lower, n and zipf, the logarithm of the frequency in a billion words."""
    return zipf_of(words.groupBy("lower").agg(F.count(F.lit(1)).alias("n")))


def zipf_of(counts: DataFrame) -> DataFrame:
    """The same from lower and n."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("lower", "n", F.round(F.log10(F.col("n") / F.col("total") * 1e9), 2).alias("zipf"))


def unit_counts(docs: DataFrame) -> DataFrame:
    """A row for each document: paragraphs, headings, sentences, longest sentence, three word counts and reading time."""
    text = F.col("text")
    rows = docs.select("doc_id", text, X.paragraphs(text).alias("p"), X.sentences(text).alias("s"))
    lengths = F.transform("s", lambda s: F.size(X.found(s, X.LETTERS)))
    return rows.select(
        "doc_id",
        F.size("p").cast("long").alias("paragraphs"),
        F.size(F.filter("p", X.is_heading)).cast("long").alias("headings"),
        F.size("s").cast("long").alias("sentences"),
        F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("longest_sentence"),
        F.size(X.white_words(text)).cast("long").alias("white_words"),
        F.size(X.found(text, X.READER_WORD)).cast("long").alias("reader_words"),
        F.size(F.filter(X.found(text, X.TOKEN), lambda t: t.rlike(r"^[\p{L}0-9]"))).cast("long").alias("tokens"),
    ).withColumn("minutes", X.reading_minutes(F.col("reader_words")))


def chunked_paragraphs(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, chunk and words: paragraphs put together in order as long as a chunk stays within the limit."""
    sizes = F.transform(X.paragraphs(F.col("text")), lambda p: F.size(X.white_words(p)))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("words"), F.array().cast("array<struct<chunk:int,words:int>>").alias("done"))

    def step(state, size):
        over = (state.words > 0) & (state.words + size > limit)
        full = F.when(over, F.concat(state.done, F.array(F.struct(state.chunk.alias("chunk"), state.words.alias("words"))))).otherwise(state.done)
        return F.struct((state.chunk + over.cast("int")).alias("chunk"), F.when(over, size).otherwise(state.words + size).alias("words"), full.alias("done"))

    def close(state):
        return F.when(state.words > 0, F.concat(state.done, F.array(F.struct(state.chunk.alias("chunk"), state.words.alias("words"))))).otherwise(state.done)

    chunks = docs.select("doc_id", F.explode(F.aggregate(sizes, start, step, close)).alias("c"))
    return chunks.select("doc_id", F.col("c.chunk").cast("long").alias("chunk"), F.col("c.words").cast("long").alias("words"))
