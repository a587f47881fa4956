"""Reading tests and what is known of readers, over typed tables: pairs of passages, recorded items, feedback, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_WPM, MOST_TRIPPED = 1200.0, 200


def tenths(value: Column) -> Column:
    """value to one place as SQL rounds doubles: ten times the value, halves away from zero."""
    return F.round(value * 10) / 10


def mean_in_order(value: str, order: str) -> Column:
    """The mean of a group, added up in order, so that its last bits, which decide between halves of a tenth, don't depend on how rows are dealt out."""
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.when(F.count(value) > 0, F.aggregate(rows, F.lit(0.0), lambda a, r: a + r[value]) / F.count(value))


def next_pairs(users: DataFrame, pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """user_id and pair: the first pair (pair, place) that a reader hasn't had, else the one at (number of tests) modulo (number of pairs).

    Pairs are few and broadcast; only what readers had is joined."""
    had = tests.groupBy("user_id").agg(F.collect_set("pair").alias("had"), F.count(F.lit(1)).alias("n"))
    order = pairs.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pair"))), lambda p: p.pair).alias("order"))
    rows = users.select("user_id").distinct().join(had, "user_id", "left").crossJoin(F.broadcast(order))
    left = F.array_except("order", F.coalesce("had", F.array().cast("array<string>")))
    return rows.select("user_id", F.coalesce(F.get(left, F.lit(0)), F.get("order", F.pmod(F.coalesce("n", F.lit(0)), F.size("order")).cast("int"))).alias("pair"))


def assignments(rows: DataFrame) -> DataFrame:
    """rows (user_id, pair) with the passage read first and the side that is rewritten, by a digest, so that a rerun agrees."""
    digit = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", "user_id", "pair")), k, 1), 16, 10).cast("int")
    return rows.select("user_id", "pair", F.when(digit(1) < 8, "a").otherwise("b").alias("first"), F.when(digit(2) < 8, "first").otherwise("second").alias("rewritten"))


def graded_items(items: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graded, rejects) of items (item_id, user_id, passage_id, condition, words, seconds, answers, tripped, recorded_at).

    correct counts answers that match the passage's key (answers); too fast readings and second recordings are rejected with a reason."""
    keys = passages.select("passage_id", F.col("answers").alias("key"))
    rows = items.join(F.broadcast(keys), "passage_id", "left")
    wpm = F.when(F.col("seconds") > 0, tenths(F.col("words") / (F.col("seconds") / 60)))
    right = F.size(F.filter(F.map_entries("key"), lambda e: F.coalesce(F.try_element_at("answers", e.key) == e.value, F.lit(False))))
    first = F.row_number().over(Window.partitionBy("item_id").orderBy("recorded_at"))
    told = F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("tripped", F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: w != ""))), 1, MOST_TRIPPED)
    rows = rows.withColumns({"wpm": wpm, "n": first}).withColumns(
        {"correct": F.when(F.col("key").isNotNull(), right), "total": F.size("key"), "tripped": told, "reason": F.when(F.col("n") > 1, "recorded_before").when(F.col("wpm").isNull(), "no_time").when(F.col("wpm") > MOST_WPM, "too_fast")}
    )
    out = rows.drop("key", "n")
    return out.filter("reason is null").drop("reason"), out.filter("reason is not null")


def results(graded: DataFrame) -> DataFrame:
    """user_id, condition, n, mean_wpm and mean comprehension in percent."""
    shares = F.avg(F.when(F.col("total") > 0, F.col("correct") / F.col("total")))
    return graded.groupBy("user_id", "condition").agg(F.count(F.lit(1)).alias("n"), tenths(mean_in_order("wpm", "item_id")).alias("mean_wpm"), tenths(100 * shares).alias("comprehension"))


def completion(items: DataFrame) -> DataFrame:
    """test_id and completed: whether all of its items are recorded."""
    return items.groupBy("test_id").agg(F.bool_and(F.col("recorded_at").isNotNull()).alias("completed"))


def site_results(graded: DataFrame) -> DataFrame:
    """Mean speed and n by condition over items with questions."""
    return graded.filter("total > 0").groupBy("condition").agg(F.round(F.avg("wpm"), 1).alias("mean_wpm"), F.count(F.lit(1)).alias("n"))


def verdict(change: Column) -> Column:
    return F.when(F.abs(change) < 3, "same").when(change > 0, "faster").otherwise("slower")


def speed_changes(by_condition: DataFrame) -> DataFrame:
    """user_id, change of speed in percent, what it says, and the difference in comprehension, for readers with both conditions."""
    rows = by_condition.groupBy("user_id").pivot("condition", ["original", "rewritten"]).agg(F.first("mean_wpm").alias("wpm"), F.first("comprehension").alias("c"))
    change = F.round((F.col("rewritten_wpm") - F.col("original_wpm")) / F.col("original_wpm") * 100).cast("long")
    rows = rows.filter("original_wpm > 0 and rewritten_wpm is not null").select("user_id", change.alias("change"), tenths(F.col("rewritten_c") - F.col("original_c")).alias("comprehension_change"))
    return rows.withColumn("verdict", verdict(F.col("change")))


def protocol(graded: DataFrame, scores: DataFrame, axes: tuple[str, ...], least_pairs: int = 3) -> DataFrame:
    """Does an axis of the battery predict the gain? For each axis: readers, correlation and slope of the mean gain in words a minute."""
    pairs = graded.groupBy("user_id", "test_id").pivot("condition", ["original", "rewritten"]).agg(F.avg("wpm")).filter("original is not null and rewritten is not null")
    gains = pairs.groupBy("user_id").agg(F.avg(F.col("rewritten") - F.col("original")).alias("gain"), F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") >= least_pairs)
    each = gains.join(scores, "user_id").select("gain", F.explode(F.create_map(*[x for a in axes for x in (F.lit(a), F.col(a))])).alias("axis", "support"))
    return each.groupBy("axis").agg(F.count(F.lit(1)).alias("readers"), F.round(F.corr("support", "gain"), 4).alias("correlation"), F.round(F.regr_slope("gain", "support"), 4).alias("slope"))


def folded_feedback(feedback: DataFrame) -> DataFrame:
    """user_id, trigger_words, safe_words and replacements from feedback (user_id, at, kind, word, put): the latest word on each counts.

    Kinds: tripped, safe, remove, and replace, which is kept apart from the lists."""
    rows = feedback.withColumn("word", F.lower(F.trim("word"))).filter("word != ''")
    state = rows.filter("kind != 'replace'").groupBy("user_id", "word").agg(F.max_by("kind", F.struct("at", "kind")).alias("kind"))
    puts = rows.filter("kind = 'replace'").groupBy("user_id", "word").agg(F.max_by(F.trim("put"), F.struct("at", "put")).alias("put"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("word"))))
    lists = state.groupBy("user_id").agg(of("tripped").alias("trigger_words"), of("safe").alias("safe_words"))
    maps = puts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "put")))).alias("replacements"))
    none = F.array().cast("array<string>")
    out = lists.join(maps, "user_id", "full")
    return out.select("user_id", F.coalesce("trigger_words", none).alias("trigger_words"), F.coalesce("safe_words", none).alias("safe_words"), F.coalesce("replacements", F.create_map().cast("map<string,string>")).alias("replacements"))


def rebased(profiles: DataFrame, bases: DataFrame) -> DataFrame:
    """profiles (user_id, base, learned parts) with the numbers of another base: what was learned from the reader stays."""
    learned = profiles.select("user_id", F.col("new_base").alias("profile"), "trigger_words", "safe_words", "replacements", "vocabulary")
    return learned.join(F.broadcast(bases.drop("trigger_words", "safe_words", "replacements", "vocabulary")), "profile")


def merged_learning(learned: DataFrame, known: DataFrame) -> DataFrame:
    """A profile learned from writing, with what the reader's earlier one (user_id, trigger_words, replacements, safe_words) knows put beside it."""
    k = known.select("user_id", F.col("trigger_words").alias("k_triggers"), F.col("safe_words").alias("k_safe"), F.col("replacements").alias("k_replacements"))
    none = F.array().cast("array<string>")
    rows = learned.join(k, "user_id", "left")
    safe = F.array_sort(F.array_except(F.array_union(F.coalesce("safe_words", none), F.coalesce("k_safe", none)), F.coalesce("k_triggers", none)))
    return rows.withColumns({"safe_words": safe, "trigger_words": F.coalesce("k_triggers", none), "replacements": F.coalesce("k_replacements", F.create_map().cast("map<string,string>"))}).drop("k_triggers", "k_safe", "k_replacements")


def erased(table: DataFrame, erase: DataFrame, keep_row: bool = False) -> DataFrame:
    """A table without the rows of readers that want to be erased; feedback keeps its rows with a null user_id and no address."""
    gone = erase.select("user_id").distinct()
    if not keep_row:
        return table.join(gone, "user_id", "left_anti")
    rows = table.join(gone.withColumn("gone", F.lit(True)), "user_id", "left")
    cleared = {c: F.when(F.col("gone").isNull(), F.col(c)) for c in ("user_id", "email") if c in table.columns}
    return rows.withColumns(cleared).select(*table.columns)
