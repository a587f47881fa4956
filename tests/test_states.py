"""Battery, reading tests, service states, pronunciations, sources and streams on small typed tables."""

import json

import pytest
from pyspark.sql import functions as F

from lexispan.operators import battery as B
from lexispan.operators import pronounce, protect, style
from lexispan.operators import readers as R
from lexispan.operators import states as S
from lexispan.plans import rules
from lexispan.sources import documents, pages
from lexispan.streaming import jobs


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def run(**raw):
    return json.dumps(raw)


def trials(*rights, rt=900.0):
    return {"trials": [{"id": str(k), "correct": bool(r), "rt_ms": rt} for k, r in enumerate(rights)]}


def probe(target, control):
    return {"trials": [{"id": c, "pair_id": "a", "condition": c, "critical_index": 1, "word_rts": [300.0, t, t, t, 300.0]} for c, t in (("target", target), ("control", control))]}


def test_battery(spark):
    spelling = {"trials": [{"word": "robert", "kind": "regular", "response": "rupert"}, {"word": "cat", "kind": "regular", "response": "dog"}, {"word": "hat", "kind": "irregular", "response": ""}, {"word": "blim", "kind": "nonword", "response": "blim"}, {"word": "frop", "kind": "nonword", "response": "x"}]}
    rows = [
        (1, run()), (2, run(orthographic_choice=trials(1, 1, 1, 1, rt=500.0), digit_span={"span": 6}, vas={"trials": [{"correct_letters": 5}, {"correct_letters": 0, "practice": True}]})),
        (3, run(orthographic_choice=trials(1, 0, 1, 0, rt=3000.0), checklist={"answers": {"c3": 4, "c6": 4}, "comfort": {"k": 4}})), (4, run(spelling=spelling)),
        (5, run(heteronym=probe(360.0, 300.0))), (6, run(heteronym=probe(400.0, 300.0))), (7, None),
    ]
    scores = B.score_battery(frame(spark, "run_id long, user_id long, raw string", *[(i, i, r) for i, r in rows])).cache()
    got = {r.run_id: r for r in scores.collect()}
    assert [got[1][a] for a in B.AXES] == [0.0] * 5 and got[1].rate_confidence == got[7].vas_confidence == "low"
    assert (got[2].orthographic, got[2].attention, got[2].vas, got[2].vas_confidence) == (0.0, 0.0, 0.0, "normal")
    assert (got[3].orthographic, got[3].phonological, got[3].comfort) == (100.0, 100.0, 100.0)
    assert (got[4].phonological, got[4].orthographic) == (75.0, 50.0)
    assert (got[5].slowdown_ms, got[5].reliable, got[6].slowdown_ms, got[6].slowdown_ratio, got[6].reliable, got[6].pairs_scored) == (60.0, False, 100.0, 0.333, True, 1)
    base = frame(spark, "profile string, weights map<string,double>, min_zipf double, max_word_length int, max_sentence_words int", ("default", {"rare": 0.7, "personal": 2.0}, 3.3, 12, 20))
    made = {r.run_id: r for r in B.profiles_from_scores(scores, base).collect()}
    assert (made[3].weights["rare"], made[3].min_zipf, made[3].phonetic_map, made[3].weights["heteronym"]) == (2.0, 4.6, "always", 2.0)
    assert (made[6].weights["heteronym"], made[6].weights["ambiguity"], made[6].weights["phrasal"], made[2].weights["phrasal"], made[2].max_sentence_words) == (1.8, 1.6, 1.5, 1.0, 20)
    assert made[6].layout == {"max_line_chars": "62", "word_spacing_em": "0.16"}
    support = frame(spark, "run_id long, user_id long, phonological double, orthographic double, rate double, vas double, attention double, reliable boolean", (1, 1, 0.0, 0.0, 0.0, 50.0, 50.0, False), (2, 2, 0.0, 0.0, 0.0, 100.0, 100.0, False))
    own = base.withColumns({"layout": F.create_map(F.lit("max_line_chars"), F.lit("50"), F.lit("font"), F.lit("Lex")), "clause_depth": F.lit(2.0)})
    made = {r.run_id: r for r in B.profiles_from_scores(support, own).collect()}
    assert made[1].layout == {"font": "Lex", "max_line_chars": "48", "word_spacing_em": "0.22"} and made[1].clause_depth == 1.5
    assert made[2].layout == {"font": "Lex", "max_line_chars": "45", "word_spacing_em": "0.28"} and made[2].clause_depth == 1.0 and made[2].max_word_length == 7


def test_support_is_rounded_as_sql_rounds(spark):
    # 14.549999999999999 and 53.349999999999994 are halves of a tenth once they are multiplied by ten
    rows = frame(spark, "x double", (14.549999999999999,), (53.349999999999994,), (14.45,), (14.55,), (None,))
    assert [r[0] for r in rows.select(B.tenths(F.col("x"))).collect()] == [14.6, 53.4, 14.4, 14.6, None]


def test_runs_are_merged_by_task(spark):
    parts = frame(spark, "run_id long, user_id long, at int, finished_at int, raw string", (1, 9, 1, None, '{"digit_span": {"span": 3}, "vas": null}'), (1, 9, 2, 5, '{"digit_span": {"span": 6}}'), (2, 9, 1, 4, "{}"))
    runs = B.merged_runs(parts)
    assert {r.run_id: json.loads(r.raw) for r in runs.collect()} == {1: {"digit_span": {"span": 6}, "vas": None}, 2: {}}
    assert [r.run_id for r in B.latest_finished(runs).collect()] == [1]


def test_reading_tests(spark):
    items = frame(
        spark, "item_id long, test_id long, user_id long, passage_id long, condition string, words int, seconds double, answers map<string,int>, tripped array<string>, recorded_at int",
        (1, 1, 7, 1, "original", 200, 60.0, {"q1": 1, "q2": 0}, ["B", "a ", "b", ""], 1), (1, 1, 7, 1, "original", 200, 30.0, {}, None, 2), (2, 1, 7, 1, "rewritten", 200, 50.0, {"q1": 1, "q2": 2}, None, 1),
        (3, 2, 8, 1, "original", 200, 1.0, None, None, 1), (4, 2, 8, 9, "rewritten", 200, None, None, None, None),
    )
    passages = frame(spark, "passage_id long, answers map<string,int>", (1, {"q1": 1, "q2": 2}))
    good, bad = R.graded_items(items, passages)
    assert {(r.item_id, r.reason) for r in bad.collect()} == {(1, "recorded_before"), (3, "too_fast"), (4, "no_time")}
    assert {(r.item_id, r.wpm, r.correct, r.total, tuple(r.tripped)) for r in good.collect()} == {(1, 200.0, 1, 2, ("a", "b")), (2, 240.0, 2, 2, ())}
    assert [tuple(r) for r in R.speed_changes(R.results(good)).collect()] == [(7, 20, 50.0, "faster")]
    assert {r.test_id: r.completed for r in R.completion(items).collect()} == {1: True, 2: False}
    users, pairs = frame(spark, "user_id long", (1,), (2,), (3,)), frame(spark, "place int, pair string", (0, "x"), (1, "y"))
    had = frame(spark, "user_id long, pair string", (1, "x"), (2, "x"), (2, "y"), (2, "x"))
    assert {(r.user_id, r.pair) for r in R.next_pairs(users, pairs, had).collect()} == {(1, "y"), (2, "y"), (3, "x")}
    assert R.assignments(had).collect() == R.assignments(had).collect()
    scores = frame(spark, "user_id long, rate double", (7, 40.0))
    assert R.protocol(good, scores, ("rate",), 1).first().readers == 1


def test_means_do_not_depend_on_the_order_of_rows(spark):
    rows = [(k, 1, "original", w, 2, 2) for k, w in enumerate((0.1, 0.7, 1e15, 0.3, -1e15, 0.2, 0.9, 0.4))]
    schema = "item_id long, user_id long, condition string, wpm double, correct int, total int"
    in_turn = 0.0
    for r in rows:
        in_turn += r[3]
    for some in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = R.results(spark.createDataFrame(some, schema).repartition(3)).collect()
        assert [(r.n, r.mean_wpm, r.comprehension) for r in got] == [(8, int(in_turn / 8 * 10 + 0.5) / 10, 100.0)]


def test_reader_knowledge(spark):
    f = frame(spark, "user_id long, at int, kind string, word string, put string", (1, 1, "tripped", " Wind", None), (1, 2, "safe", "wind", None), (1, 3, "tripped", "tear", None), (1, 4, "remove", "x", None), (1, 5, "replace", "Harvest", "crop "), (2, 1, "replace", "a", "b"))
    got = {r.user_id: r for r in R.folded_feedback(f).collect()}
    assert (got[1].trigger_words, got[1].safe_words, got[1].replacements, got[2].trigger_words) == (["tear"], ["wind"], {"harvest": "crop"}, [])
    learned = frame(spark, "user_id long, safe_words array<string>", (1, ["tear", "live"]), (3, ["z"]))
    assert {r.user_id: (r.safe_words, r.trigger_words) for r in R.merged_learning(learned, R.folded_feedback(f)).collect()} == {1: (["live", "wind"], ["tear"]), 3: (["z"], [])}
    table = frame(spark, "id long, user_id long, email string", (1, 1, "a@b.c"), (2, 2, "d@e.f"))
    gone = frame(spark, "user_id long", (1,), (1,))
    assert [r.id for r in R.erased(table, gone).collect()] == [2]
    assert {tuple(r) for r in R.erased(table, gone, keep_row=True).collect()} == {(1, None, None), (2, 2, "d@e.f")}


def test_states(spark):
    n = S.newsletter_states(frame(spark, "email string, at int, kind string, source string", (" A@b.c", 1, "signup", "x"), ("a@b.c", 2, "unsubscribe", None), ("a@b.c", 3, "signup", "y"), ("d@e.f", 1, "signup", "z"), ("d@e.f", 2, "unsubscribe", None), ("bad", 1, "signup", "q")))
    assert {tuple(r) for r in n.collect()} == {("a@b.c", "x", 1, None), ("d@e.f", "z", 1, 2)}
    t = lambda d: f"2024-01-{d:02d} 00:00:00"
    events = [("e1", 1, "updated", "s", 7, "active", t(10)), ("e2", 2, "invoice_failed", "s", 7, None, None), ("e2", 2, "invoice_failed", "s", 7, None, None), ("e3", 3, "invoice_paid", "s", 7, None, t(20)), ("e4", 1, "updated", "u", 8, "active", t(10)), ("e5", 2, "deleted", "u", 8, None, None)]
    subs = S.subscription_states(frame(spark, "event_id string, at int, type string, subscription_id string, user_id long, status string, p string", *events).withColumn("period_end", F.col("p").cast("timestamp")))
    assert {(r.subscription_id, r.status, r.plan, str(r.plan_until)) for r in subs.collect()} == {("s", "active", "pro", t(23)), ("u", "canceled", "free", "None")}
    r = S.admitted_recordings(frame(spark, "id long, user_id long, mime string, bytes long, seconds double, created_at int", *[(i, 1, "audio/webm", 10, 1.0, i) for i in range(52)], (90, 2, "x", 1, 1.0, 1), (91, 2, "audio/wav", 2**30, 1.0, 1), (92, 2, "audio/wav", 1, 5000.0, 1)))
    assert {(x.id, x.reason) for x in r.filter("reason is not null").collect()} == {(50, "full"), (51, "full"), (90, "type"), (91, "size"), (92, "length")}
    f = frame(spark, "id long, kind string, status string, tags array<string>, admin_note string, message string, context map<string,string>, created_at int", (1, "bug", "new", None, None, "m", {"plan": "pro", "user_agent": "q", "b": "2", "a": "1", "c": ""}, 1), (2, "bug", "new", ["t"], None, "n", None, 2), (3, "idea", "new", None, None, None, None, 3))
    u = frame(spark, "id long, at int, status string, tags array<string>, admin_note string", (1, 1, "seen", None, "x"), (1, 2, None, ["k"], None))
    assert {(x.id, x.status, tuple(x.tags or ()), x.admin_note) for x in S.triaged(f, u).collect()} == {(1, "seen", ("k",), "x"), (2, "new", ("t",), None), (3, "new", (), None)}
    assert [x.text for x in S.digest_text(f).collect()] == ["## bug\n- [unknown] n\n- [pro] m (a=1; b=2)", "## idea\n- [unknown] "]
    assert S.tripped_rows(frame(spark, "id long, words array<string>", (1, ["a"] * 60))).first().message.startswith("60 word(s) tripped: a, a")
    payload = json.dumps([{"word": "x", "phonetic": "", "phonetics": [{"text": "/eks/", "audio": ""}, {"audio": "u.mp3"}], "meanings": [{"partOfSpeech": "noun", "definitions": [{"definition": str(k)}]} for k in range(5)]}])
    a, b = S.definitions(frame(spark, "word string, payload string", (" X", payload), ("y", "[]"))).orderBy("word").collect()
    assert (a.word, a.phonetic, a.audio, [m.definition for m in a.meanings], a.known, b.known) == ("x", "/eks/", "u.mp3", ["0", "1", "2"], True, False)


def test_gate_cache_and_costs(spark):
    c = lambda *rows: {r.doc_id: r.reason for r in protect.reject_reasons(frame(spark, "doc_id long, original string, candidate string, names_before array<string>, names_after array<string>", *rows)).collect()}
    said = "Mrs. Alvarez paid $40 on 3 May and said “never again”."
    assert c((1, said, said, ["Alvarez"], ["alvarez"]), (2, said, "She paid some money in May and she said never again here.", [], []), (3, "One two three four.", "I rewrote two three four.", [], []), (4, "One two three.", "One two Mary.", [], ["Mary"]), (5, "A b c. D e f. G h i. J k l.", "A b c, d e f, g h i, j k l.", [], [])) == {1: None, 2: "missing_protected_span", 3: "meta_comment", 4: "new_named_entity", 5: "too_few_sentences"}
    clean = {"```text\nHi there.\n```\nmore": "Hi there.", "Here's the rewritten paragraph:\nHi.": "Hi.", "Sure, here you go\n\"Hi.\"": "Hi.", "Hi.\n\n(Note: I kept it.)": "Hi.", "'Hi.'": "Hi.", "plain": "plain"}
    rows = frame(spark, "x string", *[(k,) for k in clean]).select("x", protect.cleaned(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == clean
    texts, counts = protect.gated(frame(spark, "doc_id long, original string, candidate string", (1, "One two.", "One too."), (2, "One two.", "")), frame(spark, "doc_id long, text string", (1, "r1"), (2, "r2"), (3, "r3")))
    assert {(r.doc_id, r.text, r.source) for r in texts.collect()} == {(1, "One too.", "candidate"), (2, "r2", "rules"), (3, "r3", "rules")} and {(r.reason, r.n) for r in counts.collect()} == {("accepted", 1), ("empty", 1)}
    calls = frame(spark, "doc_id long, model string, prompt_tokens long, completion_tokens long, total_tokens long, prompt_cache_hit_tokens long, prompt_cache_miss_tokens long", (1, "m", 1000, 100, 1100, 400, None), (1, "m", 1000, None, None, None, None))
    prices = frame(spark, "model string, price_in double, price_out double, cached_share double", ("m", 1.0, 2.0, 0.02))
    assert sorted(r.cost for r in protect.call_costs(calls, prices).collect()) == [0.000808, 0.001]
    assert protect.usage_sums(calls).first().prompt_tokens == 2000
    assert {r.book_id: r.partial for r in protect.partial_flags(frame(spark, "book_id long, used int, fallback int", (1, 7, 3), (1, 6, 4), (2, 0, 0))).collect()} == {1: True, 2: False}
    cache = frame(spark, "cache_key string, last_hit string, output string", ("sample:a", None, "x"), ("b", "2024-01-01", "x"), ("c", "2024-05-01", "x"), ("d", None, "x")).withColumn("last_hit", F.col("last_hit").cast("timestamp"))
    assert {r.cache_key for r in protect.retained_cache(cache, "2024-05-02", most=1).collect()} == {"sample:a", "c"}
    filled = protect.cache_filled(cache, frame(spark, "cache_key string", ("b",), ("n",), ("m",)), frame(spark, "cache_key string, output string, accepted boolean", ("n", "new", True), ("m", "bad", False), ("b", "again", True)))
    assert {(r.cache_key, r.output) for r in filled.collect()} == {("sample:a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("n", "new")}
    two = frame(spark, "profile string, min_zipf double, weights map<string,double>, layout map<string,string>", ("a", 3.3, {"x": 1.0, "y": 2.0}, {"font": "1"}), ("b", 3.3, {"y": 2.0, "x": 1.0}, {"font": "2"}), ("c", 3.4, {"x": 1.0, "y": 2.0}, {}))
    prints = {r.profile: r.fingerprint for r in protect.profile_fingerprints(two).collect()}
    assert prints["a"] == prints["b"] != prints["c"]


def test_pronunciations(spark):
    p = frame(spark, "word string, variant int, phones array<string>", ("wind", 0, ["W", "IH1", "N", "D"]), ("wind", 1, ["W", "AY1", "N", "D"]), ("harvest", 0, ["HH", "AA1", "R", "V", "AH0", "S", "T"]), ("quiet", 0, ["K", "W", "AY1", "AH0", "T"]), ("office", 0, ["AO1", "F", "AH0", "S"]), ("extra", 0, ["EH1", "K", "S", "T", "R", "AH0"]), ("honey", 0, ["HH", "AH1", "N", "IY0"]))
    said = pronounce.respelled(p).cache()
    assert {(r.word, r.variant): r.respelling for r in said.collect()} == {("wind", 0): "WIND", ("wind", 1): "WYND", ("harvest", 0): "HAR-vuhst", ("quiet", 0): "KWY-uht", ("office", 0): "AW-fuhs", ("extra", 0): "EK-struh", ("honey", 0): "HUN-ee"}
    senses = frame(spark, "word string, pos string", ("wind", "VERB"), ("wind", "NOUN"))
    routed = pronounce.sense_routes(p, senses)
    assert {(r.pos, r.variant, r.ambiguous) for r in routed.collect()} == {("VERB", 1, False), ("NOUN", 0, False)}
    found = frame(spark, "doc_id long, profile string, kind string, start long, end long, text string, pos string, place long", (1, "a", "rare", 0, 4, "wind", "VERB", 1), (1, "a", "heteronym", 0, 4, "wind", "VERB", 0), (1, "a", "personal", 5, 12, "harvest", "NOUN", 2), (1, "off", "personal", 5, 12, "harvest", "NOUN", 0), (1, "a", "rare", 20, 25, "quiet", "ADJ", 3))
    profiles = frame(spark, "profile string, phonetic_map string, phonetic_map_kinds array<string>, phonetic_map_always_kinds array<string>, safe_words array<string>, trigger_words array<string>", ("a", "on_demand", ["heteronym", "rare"], ["heteronym"], ["Quiet"], ["Harvest"]), ("off", "off", ["rare"], [], [], ["harvest"]))
    entries = pronounce.phonetic_map(found, profiles, said, routed)
    assert {(r.profile, r.text, r.respelling, r.always) for r in entries.collect()} == {("a", "wind", "WYND", True), ("a", "harvest", "HAR-vuhst", True)}
    paras = frame(spark, "doc_id long, para_no int, start long, end long, words int", (1, 0, 0, 4, 1), (1, 1, 5, 30, 5), (1, 2, 31, 40, 5))
    kept, inside = pronounce.excerpt(paras, entries, 1)
    assert kept.count() == 1 and [r.text for r in inside.collect()] == ["wind"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"One\r\ntwo\r\n\r\n\r\nthree \xff")
    assert documents.read_texts(spark, f"file://{tmp_path}").first().text == "One two\n\nthree �"
    exports = frame(spark, "doc_id long, json string", (1, '{"items": [{"date": "d", "body": "Hi.\\nShared with friends\\n10:30"}, {"text": "Yo"}, {"body": ""}]}'), (2, '[{"content": "Hey"}]'), (3, "broken"))
    assert {(r.doc_id, r.post, r.text) for r in documents.exported_posts(exports).collect()} == {(1, 0, "Hi."), (1, 1, "Yo"), (2, 0, "Hey")}
    texts = frame(spark, "doc_id long, text string", (1, "front\nChapter 1 A\nbody\n\nmore\nchapter 2\n\nCHAPTER 3\nend"), (2, "no heads"), (3, None))
    assert {tuple(r) for r in documents.chapters(texts).collect()} == {(1, 1, "Chapter 1 A", "body\n\nmore"), (1, 2, "CHAPTER 3", "end"), (2, 1, "", "no heads")}
    known = frame(spark, "slug string, title string, body string, words int", ("a", "A", "x", 1), ("b", "B", "y", 1))
    assert {tuple(r) for r in documents.seeded(known, frame(spark, "slug string, title string, body string", ("b", "New", "one two"))).collect()} == {("a", "A", "x", 1), ("b", "New", "one two", 2)}
    documents.write_texts(frame(spark, "profile string, text string", ("p", "One.\n\nTwo.")), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").count() == 4
    html = '<html><head><meta name="author" content="Ann B"></head><body><h1>Top</h1><p>short</p></body></html>'
    (page,) = pages.imported(frame(spark, "page_id long, url string, html string, selection string", (1, "http://x.example/", html, "picked"))).collect()
    assert (page.title, page.byline, page.text, page.source, page.words) == ("Top", "Ann B", "picked", "selection", 1)


@pytest.mark.parametrize("url", ["http://[::1]/", "http://[fe80::1]/", "http://127.0.0.1./", "http://2130706433/", "http://0x7f.1/", "http://[::ffff:127.0.0.1]/", "http://[2001:db8::1]/", "http://10.0.0.1/", "http://010.0.0.1/", "ftp://a.example/", "http://localhost./", "http:///x", "http://[", "http://999.1.1.1/"])
def test_addresses_that_are_refused(spark, url):
    assert not frame(spark, "url string", (url,)).select(pages.admissible(F.col("url")).alias("y")).first().y


def test_addresses_that_pass(spark):
    urls = ["http://a.example/x", "https://8.8.8.8:443/", "http://u@B.example.", "http://[2606:4700::1111]/"]
    assert all(r.y for r in frame(spark, "url string", *[(u,) for u in urls]).select(pages.admissible(F.col("url")).alias("y")).collect())


def test_style_gives_no_text_away(spark):
    posts = frame(spark, "author long, text string", *[(1, f"But I went (once) to Zanzibar{k}... Really!! Don't SHOUT at 4155 http://x.example/{k} Smith") for k in range(20)])
    report = style.style_report(posts).first()
    assert (report.multi_exclamation_rate, report.ellipsis_rate, report.parenthesis_rate) == (0.25, 0.25, 0.25) and all(not isinstance(v, str) for v in report)
    zipf = frame(spark, "lower string, zipf double", ("but", 7.0), ("smith", 2.0), ("went", 6.0))
    out = str([tuple(r) for df in (style.starters(posts, zipf=zipf), style.connectives(posts), style.word_frequency(posts, zipf), style.learned_profiles(style.style_report(posts), style.word_frequency(posts, zipf))) for r in df.collect()])
    assert "but" in out and not any(w in out.lower() for w in ("zanzibar", "smith", "4155", "http"))
    assert [tuple(r) for r in style.heteronyms_used(posts, frame(spark, "word string, pos string", ("once", "ADV"))).collect()] == [(1, "once", 20, True)]


def stream(spark, tmp_path, rows, schema, make, name):
    spark.createDataFrame(rows, schema).repartition(1).write.mode("overwrite").json(f"file://{tmp_path}/{name}-in")
    df = make(spark.readStream.schema(schema).json(f"file://{tmp_path}/{name}-in"))
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    schema = "event_id long, user_id long, item_id long, event_type string, ts timestamp_ntz"
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(k, 1, 1, "x", at(k)) for k in range(8)] + [(3, 1, 1, "x", at(3)), (20, 1, 1, "x", at(61)), (21, 2, 1, "x", at(0))]
    assert len(stream(spark, tmp_path, rows, schema, jobs.once, "single")) == 10
    done = stream(spark, tmp_path, [(1, 1, 5, "start", at(0)), (2, 1, 5, "finish", at(9)), (3, 1, 6, "finish", at(1))], schema, jobs.finished, "ends")
    assert [(r.item_id, r.finished_at.second) for r in done] == [(5, 9)]


def test_words_by_author_stand_for_the_texts(spark):
    posts = frame(spark, "author long, text string", (1, "We SAW extraordinary Things. We saw things!"), (1, "things"), (2, "\u0130ce ice"))
    words = style.author_words(posts)
    assert [tuple(r) for r in words.filter("author = 1").orderBy("lower").collect()] == [(1, "extraordinary", 1, 13, 1, 0), (1, "saw", 2, 6, 0, 1), (1, "things", 3, 18, 0, 0), (1, "we", 2, 4, 0, 0)]
    zipf = frame(spark, "lower string, zipf double", ("things", 3.0), ("saw", 5.0), ("we", 7.0))
    assert style.style_report(posts, words).orderBy("author").collect() == style.style_report(posts).orderBy("author").collect()
    report = style.style_report(posts, words).orderBy("author").first()
    assert (report.word_length, report.long_word_rate, report.first_person, report.capitals, report.type_token) == (5.125, 0.125, 25.0, 12.5, 0.5)
    assert [tuple(r) for r in style.word_frequency(posts, zipf, words).orderBy("author").collect()] == [(1, 5.0, 0.4286), (2, 4.6, 0.0)]


def test_learned_readers_write_no_tokens(spark, monkeypatch):
    kinds, store = [], rules.stored
    monkeypatch.setattr(rules, "stored", lambda df, kind="table": (kinds.append(kind), store(df, kind))[1])
    assert rules.learned_readers(spark, "/root/testdata/sf0.001").count() > 0
    assert "words" in kinds and "tagged" not in kinds
