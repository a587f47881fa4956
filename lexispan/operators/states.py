"""States of the service from its event logs: feedback, newsletter, subscriptions, library, recordings, definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Plan states that count as paid, and those that end it (fixed values).
PAID, ENDED = ("active", "trialing", "past_due"), ("canceled", "unpaid", "incomplete_expired")
GRACE_DAYS = 3
WORD_LIMITS = {"free": 60_000, "pro": 300_000}
MOST_BYTES, MOST_SECONDS, MOST_RECORDINGS = 25 * 2**20, 15 * 60, 50
MIMES = ("audio/webm", "audio/mp4", "audio/mpeg", "audio/ogg", "audio/wav")
KINDS = ("bug", "idea", "question", "tripped", "praise")


def feedback_list(feedback: DataFrame, since: str | None = None, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Feedback that passes the filters, newest first."""
    for column, value in (("status", status), ("kind", kind)):
        feedback = feedback.filter(F.col(column) == value) if value else feedback
    return (feedback.filter(F.col("created_at") >= F.lit(since).cast("timestamp")) if since else feedback).orderBy(F.desc("created_at"), F.desc("id"))


def feedback_summary(feedback: DataFrame, as_of: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """window_days, kind and status (all for totals), n and mean rating, over windows that end at as_of; one pass."""
    end = F.lit(as_of).cast("timestamp")
    rows = feedback.withColumn("window_days", F.explode(F.array(*[F.lit(d) for d in days]))).filter((F.col("created_at") > end - F.make_dt_interval(F.col("window_days"))) & (F.col("created_at") <= end))
    out = rows.groupingSets([["window_days"], ["window_days", "kind"], ["window_days", "status"]], "window_days", "kind", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 2).alias("mean_rating"))
    return out.select("window_days", F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("status", F.lit("all")).alias("status"), "n", "mean_rating")


def digest_text(feedback: DataFrame) -> DataFrame:
    """One markdown text for each kind, newest first: the plan from the context, else unknown, and a summary of the rest cut at 240 characters."""
    context = F.coalesce("context", F.create_map().cast("map<string,string>"))
    rest = F.map_filter(context, lambda k, v: (k != "user_agent") & (k != "plan") & v.isNotNull() & (v != ""))
    told = F.substring(F.concat_ws("; ", F.transform(F.array_sort(F.map_entries(rest)), lambda e: F.concat(e.key, F.lit("="), e.value))), 1, 240)
    line = F.concat(F.lit("- ["), F.coalesce(F.try_element_at(context, F.lit("plan")), F.lit("unknown")), F.lit("] "), F.coalesce("message", F.lit("")), F.when(told != "", F.concat(F.lit(" ("), told, F.lit(")"))).otherwise(""))
    lines = feedback.filter(F.col("kind").isin(*KINDS)).select("kind", "created_at", "id", line.alias("line"))
    texts = lines.groupBy("kind").agg(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "id", "line")))).alias("ls"))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return texts.select("kind", place.alias("place"), F.concat(F.lit("## "), "kind", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x.line), "\n")).alias("text")).orderBy("place")


def tripped_rows(reports: DataFrame) -> DataFrame:
    """reports (id, words: an array) as feedback: a message with the count and the first 20 words, and at most 50 of them as context."""
    words = F.coalesce("words", F.array().cast("array<string>"))
    message = F.concat(F.size(words).cast("string"), F.lit(" word(s) tripped: "), F.array_join(F.slice(words, 1, 20), ", "))
    return reports.select("id", F.lit("tripped").alias("kind"), message.alias("message"), F.slice(words, 1, 50).alias("words"))


def triaged(feedback: DataFrame, updates: DataFrame) -> DataFrame:
    """feedback with the last value that updates (id, at, status, tags, admin_note) give of each column; null leaves it."""
    last = updates.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"u_{c}") for c in ("status", "tags", "admin_note")])
    rows = feedback.join(last, "id", "left")
    return rows.withColumns({c: F.coalesce(f"u_{c}", c) for c in ("status", "tags", "admin_note")}).select(*feedback.columns)


def path_of(path: Column) -> Column:
    """A path with a leading slash, 300 characters at most."""
    clean = F.trim(F.coalesce(path, F.lit("")))
    return F.substring(F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit("/"), clean)), 1, 300)


def page_views(hits: DataFrame) -> DataFrame:
    """day, path, referrer host and views of hits (ts, path, referrer)."""
    host = F.lower(F.coalesce(F.try_parse_url("referrer", F.lit("HOST")), F.lit("")))
    return hits.groupBy(F.to_date("ts").alias("day"), path_of(F.col("path")).alias("path"), host.alias("referrer_host")).agg(F.count(F.lit(1)).alias("views"))


def site_stats(signups: DataFrame, views: DataFrame, users: DataFrame, books: DataFrame, as_of: str) -> DataFrame:
    """One row: signups, users, pro users, books, and views of 30 days by path as a map of the hundred most seen."""
    recent = views.filter(F.col("day") > F.date_sub(F.lit(as_of).cast("date"), 30)).groupBy("path").agg(F.sum("views").alias("n")).orderBy(F.desc("n"), "path").limit(100)
    paths = recent.agg(F.map_from_entries(F.collect_list(F.struct("path", "n"))).alias("views_by_path"))
    counts = signups.agg(F.count_if(F.col("unsubscribed_at").isNull()).alias("signups")).crossJoin(users.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("plan") == "pro").alias("pro_users"))).crossJoin(books.agg(F.count(F.lit(1)).alias("books")))
    return counts.crossJoin(paths)


def pulse(*parts: DataFrame) -> DataFrame:
    """One row of JSON for several tables of bounded size (summaries, axis means, results): an array for each."""
    out = None
    for k, part in enumerate(parts):
        one = part.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*part.columns)))).alias(f"p{k}"))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.to_json(F.struct(*out.columns)).alias("pulse"))


def newsletter_states(events: DataFrame) -> DataFrame:
    """email, source, created_at and unsubscribed_at from events (email, at, kind: signup or unsubscribe, source): the first source stays, a signup clears an unsubscription."""
    rows = events.withColumn("email", F.lower(F.trim("email"))).filter(F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
    signup = F.col("kind") == "signup"
    out = rows.groupBy("email").agg(F.min_by("source", F.when(signup, F.col("at"))).alias("source"), F.min(F.when(signup, F.col("at"))).alias("created_at"), F.max_by(F.struct("kind", "at"), F.struct("at", signup)).alias("last"))
    return out.filter("created_at is not null").select("email", "source", "created_at", F.when(F.col("last.kind") == "unsubscribe", F.col("last.at")).alias("unsubscribed_at"))


def subscription_states(events: DataFrame) -> DataFrame:
    """subscription_id, user_id, status, plan and plan_until from events (event_id, at, type, subscription_id, user_id, status, period_end).

    Events that come twice count once; deleted ends the plan, a paid invoice extends it, a failed one makes it past_due without ending it."""
    once = events.dropDuplicates(["event_id"]).filter("subscription_id is not null")
    status = F.when(F.col("type") == "deleted", "canceled").when(F.col("type") == "invoice_failed", "past_due").when(F.col("type") == "invoice_paid", F.coalesce("status", F.lit("active"))).otherwise(F.col("status"))
    last = once.withColumn("now", status).groupBy("subscription_id").agg(F.max("user_id").alias("user_id"), F.max_by("now", F.when(F.col("now").isNotNull(), F.struct("at", "event_id"))).alias("status"), F.max(F.when(F.col("type") != "deleted", F.col("period_end"))).alias("period_end"))
    plan = F.when(F.col("status").isin(*PAID), "pro").otherwise("free")
    return last.select("subscription_id", "user_id", "status", plan.alias("plan"), F.when(plan == "pro", F.col("period_end") + F.make_dt_interval(F.lit(GRACE_DAYS))).alias("plan_until"))


def is_pro(plan: Column, plan_until: Column, at: Column) -> Column:
    return (plan == "pro") & (plan_until.isNull() | (plan_until > at))


def plan_at(events: DataFrame, states: DataFrame) -> DataFrame:
    """events (user_id, at) with the plan that the latest state (user_id, at, plan, plan_until) before or at it gives, and the quota of words; one union and window, no range join."""
    s = states.select("user_id", "at", F.struct("plan", "plan_until").alias("state"), F.lit(0).alias("order"), F.lit(None).cast(events.select(F.struct("*").alias("e")).schema["e"].dataType).alias("e"))
    e = events.select("user_id", "at", F.lit(None).cast(s.schema["state"].dataType).alias("state"), F.lit(1).alias("order"), F.struct("*").alias("e"))
    known = F.last("state", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0))
    rows = s.unionByName(e).withColumn("known", known).filter("e is not null")
    pro = F.coalesce(is_pro(F.col("known.plan"), F.col("known.plan_until"), F.col("at")), F.lit(False))
    return rows.select("e.*", pro.alias("pro"), F.when(pro, WORD_LIMITS["pro"]).otherwise(WORD_LIMITS["free"]).alias("word_limit"))


def library_status(books: DataFrame) -> DataFrame:
    """user_id, status, books, words, chapters, mean progress and cost; books over their plan's words count as rejected."""
    limit = F.when(F.col("plan") == "pro", WORD_LIMITS["pro"]).otherwise(WORD_LIMITS["free"])
    rows = books.withColumn("status", F.when(F.col("words") > limit, "rejected").otherwise(F.col("status")))
    return rows.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("books"), F.sum("words").alias("words"), F.sum("chapters").alias("chapters"), F.round(F.avg("progress"), 1).alias("progress"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def recording_totals(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("user_id").agg(F.count(F.lit(1)).alias("recordings"), F.round(F.sum("seconds"), 1).alias("seconds"), F.sum("bytes").alias("bytes"))


def admitted_recordings(recordings: DataFrame) -> DataFrame:
    """recordings with the reason against each, null if admitted: type, size, length, then more than 50 admitted of a reader, in order of time."""
    bad = F.when(~F.coalesce(F.col("mime").isin(*MIMES), F.lit(False)), "type").when(F.col("bytes") > MOST_BYTES, "size").when(F.col("seconds") > MOST_SECONDS, "length")
    rows = recordings.withColumn("reason", bad)
    n = F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy("user_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("reason", F.coalesce("reason", F.when(n > MOST_RECORDINGS, "full")))


def definitions(lookups: DataFrame) -> DataFrame:
    """word, phonetic, audio and up to three meanings (part, definition) of lookups (word, payload: JSON array of entries); words without an entry are negative."""
    entry = "array<struct<word:string,phonetic:string,phonetics:array<struct<text:string,audio:string>>,meanings:array<struct<partOfSpeech:string,definitions:array<struct<definition:string>>>>>>"
    rows = lookups.select(F.lower(F.trim("word")).alias("word"), F.get(F.from_json("payload", entry), F.lit(0)).alias("e"))
    filled = lambda c: F.when(c.isNotNull() & (c != ""), c)
    texts = F.filter(F.transform("e.phonetics", lambda p: p.text), lambda x: x.isNotNull() & (x != ""))
    audio = F.filter(F.transform("e.phonetics", lambda p: p.audio), lambda x: x.isNotNull() & (x != ""))
    meanings = F.filter(F.transform("e.meanings", lambda m: F.struct(m.partOfSpeech.alias("part"), F.get(m.definitions, F.lit(0)).definition.alias("definition"))), lambda m: m.definition.isNotNull())
    return rows.select("word", F.coalesce(filled(F.col("e.phonetic")), F.get(texts, F.lit(0))).alias("phonetic"), F.get(audio, F.lit(0)).alias("audio"), F.slice(meanings, 1, 3).alias("meanings"), F.col("e").isNotNull().alias("known"))


def normal_email(email: Column) -> Column:
    """The address in small letters without blanks around it, null if it isn't one."""
    clean = F.lower(F.trim(email))
    return F.when(clean.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), clean)


def normal_word(word: Column) -> Column:
    """The word in small letters without blanks around it, null if it has other signs than letters, apostrophes and hyphens, or over 40."""
    clean = F.lower(F.trim(word))
    return F.when(clean.rlike(r"^[\p{L}][\p{L}'’-]{0,39}$"), clean)
