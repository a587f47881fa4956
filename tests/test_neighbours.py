"""Look-alikes near each other against a comparison of all words, and what the query shuffles."""

import random
import re

from lexispan import plans
from lexispan.operators import triggers
from lexispan.operators.neighbours import near_lookalike_rows
from lexispan.operators.token_table import completed, load_profiles, token_table
from lexispan.plans import rules


def one_apart(a, b):
    if a == b or min(len(a), len(b)) < 4:
        return False
    cut = lambda w: {(i, w[:i] + w[i + 1 :]) for i in range(len(w))}
    swaps = lambda w: {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
    return bool(cut(a) & cut(b)) or b in {k for _, k in cut(a)} or a in {k for _, k in cut(b)} or b in swaps(a)


def by_comparison(rows, sentences):
    tokens = {}
    for doc_id, text in rows:
        kept = [s for s in re.findall(r"[^.!?\n]+[.!?]*", text or "") if re.search(r"[^\W_]", s)]
        for k, s in enumerate(kept):
            tokens.setdefault(doc_id, set()).update((k, i, w.lower()) for i, w in enumerate(re.findall(r"[^\W\d_]+", s)))
    out = set()
    for doc_id, held in tokens.items():
        for s, i, w in held:
            before = [e for e in held if e[:2] < (s, i) and s - e[0] <= sentences and one_apart(w, e[2])]
            if before:
                out.add((doc_id, s, i, w, min(before)[2], min(before)[0]))
    return out


def test_equals_a_comparison_of_all_words(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abA", k=rng.choice([2, 4, 4, 5, 5, 6])))
    sentence = lambda: " ".join(word() for _ in range(rng.choice([1, 2, 5, 12])))
    rows = [(k % 25, rng.choice([". ", "\n12\n", "! ?"]).join(sentence() for _ in range(rng.randint(1, 7)))) for k in range(30)]
    rows += [(50, None), (51, ""), (52, "form from form. 12. From forms"), (53, " ".join(["abcd", "abce"] * 300)), (54, "fürs fürst. x. fürs")]
    docs = spark.createDataFrame([*rows, (None, "form from")], "doc_id long, text string")
    for sentences in (0, 1, 2):
        got = near_lookalike_rows(docs, sentences).collect()
        assert {tuple(r) for r in got} == by_comparison(rows, sentences) and len(got) == len({tuple(r) for r in got})
    assert near_lookalike_rows(docs.limit(0)).count() == 0


def test_only_texts_are_shuffled(spark):
    df = plans.queries()["near_pair_triggers"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pairs_of_tokens_meet_by_sentence(spark):
    """Words of a pair that come again and again in a document only meet inside a window, and windows of several sizes keep their own partners."""
    text = ". ".join(["form", "from"] * 60)
    tokens = completed(token_table(spark.createDataFrame([(1, text), (2, "from x. y. z. form. form from")], "doc_id long, text string")))
    pairs = spark.createDataFrame([("form", "from", 2), ("from", "form", 2)], "word string, other string, rank int")
    profiles = load_profiles(spark.createDataFrame([('{"name": "a", "phonetic_window_sentences": 0}',), ('{"name": "b", "phonetic_window_sentences": 3}',)], "json string"))
    found = triggers.near_pairs(tokens, pairs, profiles)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "doc_id" in line]
    assert joins and all("sent_index" in line for line in joins)
    got = {(r.doc_id, r.profile, r.sent_index) for r in found.collect()}
    assert got == {(1, "b", k) for k in range(1, 120)} | {(2, "a", 4), (2, "b", 3), (2, "b", 4)}


def test_rewriting_looks_for_what_it_reads(spark, monkeypatch):
    asked, analyze = [], triggers.analyze
    monkeypatch.setattr(triggers, "analyze", lambda *a, kinds, **k: asked.append(kinds) or analyze(*a, kinds=kinds, **k))
    rules.Raw(spark, "/root/testdata/sf0.001").triggers(rules.REWRITTEN)
    assert asked == [("personal", "phrasal", "ambiguity", "syntax")]
