"""Documents from files and exports, chapters, seed tables, and the sinks of reports and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispan.functions import text as X

ATX_HEADING = r"^#{1,6}\s+\S"
CHAPTER_HEADING = r"(?i)^\s*chapter\s+\S+"
#: Keys under which an export keeps its list and a post its text, in the order of preference (fixed values).
LIST_KEYS, TEXT_KEYS = ("items", "posts", "messages", "entries", "data"), ("body", "text", "message", "content", "post")


def read_texts(spark: SparkSession, path: str, markdown: bool = False) -> DataFrame:
    """path and text of every file under path, hard-wrapped lines joined and, for markdown, marks taken off."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", clean_text(F.col("value"), markdown).alias("text"))


def clean_text(text: Column, markdown: bool = False) -> Column:
    return X.joined_lines(X.without_markdown(text) if markdown else text)


def exported_posts(rows: DataFrame) -> DataFrame:
    """doc_id, post and text of JSON exports (doc_id, json): a list, or an object that holds one under a known key.

    Closing lines that tell audience or time are taken off; posts without text are left out."""
    post = "struct<" + ",".join(f"{k}:string" for k in TEXT_KEYS) + ">"
    holder = "struct<" + ",".join(f"{k}:array<{post}>" for k in LIST_KEYS) + ">"
    as_list = F.from_json("json", f"array<{post}>")
    held = F.from_json("json", holder)
    posts = F.when(F.ltrim("json").startswith("["), as_list).otherwise(F.coalesce(*[held[k] for k in LIST_KEYS]))
    each = rows.select("doc_id", F.posexplode(posts).alias("post", "p")).select("doc_id", "post", F.coalesce(*[F.when(F.col(f"p.{k}") != "", F.col(f"p.{k}")) for k in TEXT_KEYS]).alias("text"))
    tail = r"(?i)(\n\s*(shared with|audience|visible to|posted|updated|[0-9]{1,2}:[0-9]{2})[^\n]*)+\s*\z"
    return each.withColumn("text", F.trim(F.regexp_replace("text", tail, ""))).filter("text != ''")


def chapters(docs: DataFrame, heading: str = CHAPTER_HEADING) -> DataFrame:
    """doc_id, chapter, title and body: what follows a line that matches heading; a text without one is one chapter without a title.

    Text before the first heading and chapters without a body are dropped. Every row of docs is cut up by itself, so rows that share a doc_id, or have none, don't mix."""
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    lines = numbered.select("doc_id", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    order = Window.partitionBy("row").orderBy("i")
    lines = lines.withColumn("head", F.col("line").rlike(heading)).withColumn("section", F.sum(F.col("head").cast("int")).over(order))
    lines = lines.withColumn("heads", F.max("section").over(Window.partitionBy("row"))).filter("section > 0 or heads = 0")
    title = F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", r"^#+\s*", ""))))
    parts = lines.groupBy("doc_id", "row", "section").agg(title.alias("title"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))).alias("ls"))
    parts = parts.withColumn("body", F.trim(F.regexp_replace(F.array_join(F.transform("ls", lambda x: x.line), "\n"), r"\A\s+|\s+\z", ""))).filter("body != ''")
    number = F.row_number().over(Window.partitionBy("row").orderBy("section"))
    return parts.select("doc_id", number.cast("long").alias("chapter"), F.coalesce("title", F.lit("")).alias("title"), "body")


def seeded(known: DataFrame, seeds: DataFrame) -> DataFrame:
    """known with seeds (slug, title, body, and at where there is an order) put in or over by slug; words are counted anew.

    Of a slug that comes twice the last seed counts: the greatest at, or the last row of a file where there is no such column."""
    order = F.col("at") if "at" in seeds.columns else F.monotonically_increasing_id()
    last = seeds.withColumn("seed_order", order).groupBy("slug").agg(F.max_by(F.struct("title", "body"), "seed_order").alias("s"))
    fresh = last.select("slug", "s.title", "s.body").withColumn("words", F.size(X.white_words(F.col("body"))))
    return known.join(fresh.select("slug"), "slug", "left_anti").select("slug", "title", "body", "words").unionByName(fresh)


def write_report(report: DataFrame, path: str) -> None:
    """Reports as JSON lines, a folder for each profile."""
    report.write.mode("overwrite").partitionBy("profile").json(path)


def write_texts(documents: DataFrame, path: str) -> None:
    """Rewritten texts (profile, text) as text files by profile; a text's blank lines stay, a line of three stars stands between two."""
    documents.select("profile", F.concat("text", F.lit("\n***")).alias("value")).write.mode("overwrite").partitionBy("profile").text(path)
