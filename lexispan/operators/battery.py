"""Scores of test batteries: runs with nested results to axes of support, and reader profiles from them.

A run has run_id, user_id, finished_at and raw, the results as JSON (RAW). Every task is optional: an axis without a
task rests on the checklist alone and has low confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RAW = (
    "checklist struct<answers:map<string,int>,comfort:map<string,int>>, spelling struct<trials:array<struct<id:string,word:string,kind:string,response:string>>>, "
    "orthographic_choice struct<trials:array<struct<id:string,correct:boolean,rt_ms:double>>>, pseudohomophone struct<trials:array<struct<id:string,correct:boolean,rt_ms:double>>>, "
    "vas struct<trials:array<struct<id:string,correct_letters:int,practice:boolean>>>, digit_span struct<span:int>, "
    "heteronym struct<trials:array<struct<id:string,pair_id:string,condition:string,critical_index:int,word_rts:array<double>>>>"
)
AXES = ("phonological", "orthographic", "rate", "vas", "attention")
#: Items of the checklist that add to an axis (fixed values).
ITEMS = {"rate": ("c1", "c8", "c10"), "attention": ("c2", "c5", "c7"), "phonological": ("c4", "c3"), "orthographic": ("c3", "c6"), "vas": ("c2",)}
#: Value for no support and value for full support (fixed values).
ANCHORS = {"accuracy": (1.0, 0.5), "vas": (5.0, 2.0), "digit_span": (6.0, 3.0), "rate": (250.0, 700.0), "spillover": (0.0, 150.0), "rt_bonus": (800.0, 3000.0), "item": (1.0, 4.0)}
RT_BONUS, CHECKLIST_SHARE, RELIABLE_MS, RELIABLE_RATIO = 15.0, 0.20, 80.0, 0.15


def anchored(value: Column, name: str) -> Column:
    """0 at one anchor, 100 at the other, straight between them and clipped outside; null stays null."""
    zero, full = ANCHORS[name]
    # least and greatest skip nulls, so a missing value is kept out of them
    return F.when(value.isNotNull(), F.least(F.greatest((value - zero) / (full - zero) * 100, F.lit(0.0)), F.lit(100.0)))


def _mean(*parts: Column) -> Column:
    """Mean of the parts that aren't null."""
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def _mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def tenths(value: Column) -> Column:
    """value to one place as SQL rounds doubles: ten times the value, ties to the even whole number."""
    return F.rint(value * 10) / 10


def _median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(values)
    low, high = F.get(s, ((n - 1) / 2).cast("int")), F.get(s, (n / 2).cast("int"))
    return F.when(n > 0, low + (high - low) * 0.5)


def classified_spelling(trials: DataFrame) -> DataFrame:
    """trials (word, kind, response) with correct and classification; plausible means an equal sound code. Nonwords aren't classed."""
    typed, target = F.trim(F.lower(F.coalesce("response", F.lit("")))), F.trim(F.lower("word"))
    nonword = F.coalesce("kind", F.lit("regular")) == "nonword"
    kind = F.when(typed == "", F.when(~nonword, "omitted")).when(typed == target, "correct").when(~nonword, F.when(F.soundex(typed) == F.soundex(target), "plausible").otherwise("implausible"))
    return trials.withColumns({"correct": (typed != "") & (typed == target), "classification": kind})


def spelling_summary(trials: DataFrame) -> DataFrame:
    """A row for each run_id: errors by class and their shares, and nonword accuracy."""
    rows = classified_spelling(trials)
    nonword = F.coalesce("kind", F.lit("regular")) == "nonword"
    of = lambda c: F.count_if((F.col("classification") == c) & ~nonword)
    out = rows.groupBy("run_id").agg(of("plausible").alias("plausible_errors"), of("implausible").alias("implausible_errors"), F.count_if(nonword).alias("nonword_total"), F.count_if(nonword & F.col("correct")).alias("nonword_correct"))
    errors = F.col("plausible_errors") + F.col("implausible_errors")
    share = lambda c: F.when(errors > 0, F.col(c) / errors).otherwise(0.0)
    return out.select("run_id", errors.alias("word_errors"), "plausible_errors", "implausible_errors", share("plausible_errors").alias("plausible_fraction"), share("implausible_errors").alias("implausible_fraction"), F.when(F.col("nonword_total") > 0, F.col("nonword_correct") / F.col("nonword_total")).alias("nonword_accuracy"), "nonword_total")


def _choice(task: str) -> tuple[Column, Column]:
    """(accuracy, median response time) of a choice task."""
    trials = F.col(f"r.{task}.trials")
    right = F.size(F.filter(trials, lambda t: F.coalesce(t.correct, F.lit(False))))
    times = F.transform(F.filter(trials, lambda t: t.rt_ms > 0), lambda t: t.rt_ms)
    return F.when(F.size(trials) > 0, right / F.size(trials)), F.when(F.size(trials) > 0, _median(times))


def heteronym_probe(trials: DataFrame) -> DataFrame:
    """A row for each run_id: pairs scored, slowdown in ms and as a ratio, spillover and whether it is reliable.

    trials have run_id, at (their place), pair_id, condition, critical_index and word_rts; of several with equal pair and condition the last counts."""
    region = lambda first, n: _mean_of(F.filter(F.slice("word_rts", first + 1, n), lambda x: x > 0))
    c = F.col("critical_index")
    ok = trials.filter("pair_id is not null and condition in ('target', 'control')").groupBy("run_id", "pair_id", "condition").agg(F.max_by(F.struct("critical_index", "word_rts"), "at").alias("t"))
    ok = ok.select("run_id", "pair_id", "condition", "t.*").filter("critical_index is not null").select("run_id", "pair_id", "condition", region(c, 3).alias("region"), region(c + 1, 2).alias("spill"))
    pairs = ok.groupBy("run_id", "pair_id").pivot("condition", ["target", "control"]).agg(F.first("region").alias("region"), F.first("spill").alias("spill"))
    pairs = pairs.withColumns({"diff": F.col("target_region") - F.col("control_region"), "over": F.col("target_spill") - F.col("control_spill")})
    out = pairs.groupBy("run_id").agg(F.count("diff").alias("pairs_scored"), F.avg("diff").alias("ms"), F.avg(F.when(F.col("diff").isNotNull(), F.col("control_region"))).alias("base"), F.avg("over").alias("spill"))
    ratio = F.when(F.col("base") > 0, F.col("ms") / F.col("base"))
    return out.select("run_id", "pairs_scored", F.bround("ms", 1).alias("slowdown_ms"), F.bround(ratio, 3).alias("slowdown_ratio"), F.bround("spill", 1).alias("spillover_ms"), F.coalesce((F.col("ms") > RELIABLE_MS) & (ratio > RELIABLE_RATIO), F.lit(False)).alias("reliable"))


def merged_runs(parts: DataFrame) -> DataFrame:
    """Runs from parts (run_id, user_id, at, finished_at, raw), task by task: of a task sent twice the later one counts."""
    each = parts.select("run_id", "user_id", "at", "finished_at", F.explode_outer(F.from_json("raw", "map<string,string>")).alias("task", "result"))
    last = each.groupBy("run_id", "task").agg(F.max_by("result", "at").alias("result"), F.max("user_id").alias("user_id"), F.max("finished_at").alias("finished_at"))
    pieces = F.concat(F.to_json(F.array("task")).substr(F.lit(2), F.length(F.to_json(F.array("task"))) - 2), F.lit(":"), F.coalesce("result", F.lit("null")))
    return last.groupBy("run_id").agg(F.max("user_id").alias("user_id"), F.max("finished_at").alias("finished_at"), F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("task").isNotNull(), pieces))), ","), F.lit("}")).alias("raw"))


def latest_finished(runs: DataFrame) -> DataFrame:
    """Each reader's last finished run; ties by run_id."""
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("finished_at"), F.desc("run_id")))
    return runs.filter("finished_at is not null").withColumn("n", last).filter("n = 1").drop("n")


def score_battery(runs: DataFrame) -> DataFrame:
    """run_id, user_id, support and confidence of every axis, comfort, and the heteronym probe."""
    rows = runs.select("run_id", "user_id", F.from_json(F.coalesce("raw", F.lit("{}")), RAW).alias("r"))
    spelling = spelling_summary(rows.select("run_id", F.explode("r.spelling.trials").alias("t")).select("run_id", "t.*"))
    trials = rows.select("run_id", F.posexplode("r.heteronym.trials").alias("at", "t")).select("run_id", "at", "t.*")
    probe = heteronym_probe(trials)
    times = F.filter(F.flatten(F.transform(F.col("r.heteronym.trials"), lambda t: F.coalesce(t.word_rts, F.array().cast("array<double>")))), lambda x: x > 0)
    (c_acc, c_rt), (d_acc, d_rt) = _choice("orthographic_choice"), _choice("pseudohomophone")
    real = F.filter(F.col("r.vas.trials"), lambda t: ~F.coalesce(t.practice, F.lit(False)))
    span = _mean_of(F.transform(real, lambda t: F.coalesce(t.correct_letters, F.lit(0)).cast("double")))
    row = rows.join(spelling, "run_id", "left").join(probe, "run_id", "left").withColumns(
        {"c_acc": c_acc, "c_rt": c_rt, "d_acc": d_acc, "d_rt": d_rt, "median_rt": _median(times), "span": span, "digits": F.col("r.digit_span.span").cast("double")}
    )
    bonus = lambda rt: F.coalesce(anchored(F.col(rt), "rt_bonus"), F.lit(0.0)) / 100 * RT_BONUS
    choice = lambda k: F.when(F.col(f"{k}_acc").isNotNull(), F.least(F.lit(100.0), anchored(F.col(f"{k}_acc"), "accuracy") + bonus(f"{k}_rt")))
    task = {
        "phonological": _mean(anchored(F.col("nonword_accuracy"), "accuracy"), F.col("implausible_fraction") * 100, choice("d")),
        "orthographic": _mean(F.col("plausible_fraction") * 100, choice("c")),
        "rate": anchored(F.col("median_rt"), "rate"),
        "vas": anchored(F.col("span"), "vas"),
        "attention": _mean(anchored(F.col("digits"), "digit_span"), anchored(F.col("spillover_ms"), "spillover")),
    }
    answer = lambda i: anchored(F.try_element_at("r.checklist.answers", F.lit(i)).cast("double"), "item")
    out = row
    for axis in AXES:
        check = F.coalesce(_mean(*[answer(i) for i in ITEMS[axis]]), F.lit(0.0))
        out = out.withColumn(f"{axis}_task", task[axis])
        combined = F.when(F.col(f"{axis}_task").isNull(), check).otherwise(F.least(F.lit(100.0), F.col(f"{axis}_task") + CHECKLIST_SHARE * check))
        out = out.withColumns({axis: tenths(combined), f"{axis}_confidence": F.when(F.col(f"{axis}_task").isNull(), "low").otherwise("normal")})
    comfort = _mean_of(F.transform(F.map_values("r.checklist.comfort"), lambda v: F.least(F.greatest((v.cast("double") - 1) / 3 * 100, F.lit(0.0)), F.lit(100.0))))
    columns = [c for axis in AXES for c in (axis, f"{axis}_confidence")]
    return out.select("run_id", "user_id", *columns, tenths(F.coalesce(comfort, F.lit(0.0))).alias("comfort"), "slowdown_ms", "slowdown_ratio", F.coalesce("reliable", F.lit(False)).alias("reliable"), F.coalesce("pairs_scored", F.lit(0)).alias("pairs_scored"))


def profiles_from_scores(scores: DataFrame, base: DataFrame) -> DataFrame:
    """Profiles of scored runs on top of a base (a table of one profile): every number only moves to more help.

    Lines get shorter and blanks wider by the support for attention at a glance, in the base's layout (62 characters and 0.16 em where it says nothing); the
    depth of clauses that a reader is given falls to 1 by the support for attention, from the base's clause_depth or 1.2."""
    row = scores.crossJoin(F.broadcast(base))
    laid = F.coalesce("layout", F.create_map().cast("map<string,string>")) if "layout" in base.columns else F.create_map().cast("map<string,string>")
    depth = F.coalesce("clause_depth", F.lit(1.2)) if "clause_depth" in base.columns else F.lit(1.2)
    line, blank = F.coalesce(F.try_element_at(laid, F.lit("max_line_chars")).cast("double"), F.lit(62.0)), F.coalesce(F.try_element_at(laid, F.lit("word_spacing_em")).cast("double"), F.lit(0.16))
    between = lambda axis, low, high: F.lit(low) + F.col(axis) / 100 * (F.lit(high) - F.lit(low)) if not isinstance(low, Column) else low + F.col(axis) / 100 * (F.lit(high) - low)
    w = lambda kind: F.coalesce(F.try_element_at("weights", F.lit(kind)), F.lit(1.0))
    up = lambda have, *wanted: F.bround(F.greatest(have, *wanted), 2)
    sure = lambda x: F.when(F.col("reliable"), F.lit(x))
    weights = {
        "personal": w("personal"), "rare": up(w("rare"), between("phonological", 1.0, 2.0)), "long": up(w("long"), between("phonological", 1.0, 1.6), between("vas", 1.0, 2.0)),
        "heteronym": up(w("heteronym"), between("orthographic", 1.0, 2.0), sure(1.8)), "ambiguity": up(w("ambiguity"), between("orthographic", 1.0, 2.0), sure(1.6)), "phonetic": up(w("phonetic"), between("orthographic", 1.0, 1.8)),
        "phrasal": up(w("phrasal"), sure(1.5)), "syntax": up(w("syntax"), between("rate", 1.0, 1.6), between("attention", 1.0, 2.0)),
    }
    words = F.col("max_sentence_words").cast("double")
    by_rate = F.bround(F.least(words, between("rate", words, 14.0)))
    letters = F.col("max_word_length").cast("double")
    return row.select(
        "run_id", "user_id", F.concat("profile", F.lit("+battery")).alias("profile"), F.create_map(*[x for k, c in weights.items() for x in (F.lit(k), c.cast("double"))]).alias("weights"),
        F.bround(F.greatest("min_zipf", between("phonological", F.col("min_zipf"), 4.6)), 2).alias("min_zipf"),
        F.bround(F.least(letters, between("vas", letters, 7.0))).cast("int").alias("max_word_length"),
        F.bround(F.least(by_rate, between("attention", by_rate, 10.0))).cast("int").alias("max_sentence_words"),
        F.when(F.col("phonological") >= 50, "always").otherwise("on_demand").alias("phonetic_map"),
        F.map_concat(
            F.map_filter(laid, lambda k, _: ~k.isin("max_line_chars", "word_spacing_em")),
            F.create_map(F.lit("max_line_chars"), F.bround(F.least(line, between("vas", line, 45.0))).cast("int").cast("string"), F.lit("word_spacing_em"), F.bround(F.greatest(blank, between("vas", blank, 0.28)), 3).cast("string")),
        ).alias("layout"),
        F.bround(F.least(depth, between("attention", depth, 1.0)), 2).alias("clause_depth"),
    )


def mean_support(scores: DataFrame) -> DataFrame:
    """Mean support of each axis over runs."""
    each = scores.select(F.explode(F.create_map(*[x for a in AXES for x in (F.lit(a), F.col(a))])).alias("axis", "support"))
    return each.groupBy("axis").agg(F.round(F.avg("support"), 1).alias("mean_support"), F.count("support").alias("runs"))
