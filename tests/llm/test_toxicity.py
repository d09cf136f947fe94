import zlib

import pytest

from tidemark.llm import toxicity as x
from tidemark.llm.common import table

SF = "/root/testdata/sf0.1"


def test_patterns_not_words():
    m = x.Matcher(x.Grammar({"idiot": 4.0}, {"lowe": 3.0}))
    c = lambda t: m.clauses(t)
    assert c("you idiot") > c("the idiot") > c("she said the idiot") > c("not an idiot") > [0]
    assert c("it is lowely here") == [3.0] and c("nothing here") == []
    assert c("i will kill you") and not c("they kill time")
    assert len(c("idiot. idiot! fine")) == 2
    assert m.score(None) == m.score("") == m.score("clean text") < 0.3


def test_targets_after_and_threats_in_four_languages():
    m = x.Matcher(x.Grammar({"idiot": 4.0}, {}))
    c = lambda t: sum(m.clauses(t))
    assert c("idiot like you") == c("you idiot") == 4.0 * 1.3 and c("idiot. you") == c("idiot and so on and you") == 4.0
    assert c("you idiot you") == 4.0 * 1.3 and abs(c("she said idiot you") - 4.0 * 1.3 * 0.5) < 1e-9
    for t in ("i will hurt you", "ich werde dich umbringen", "je vais te tuer", "voy a matarte"):
        assert c(t) > 0, t
    assert not c("er will die Tür") and not c("on peut tuer le temps") and not c("wird die Sonne")


def test_each_automaton_changes_scores_for_the_better(spark):
    """Labels that hang on target, negation and report: with any one factor at 1, more of other texts are misjudged."""

    def texts(a, b):
        out = []
        for k in range(a, b):
            out += [(f"w{k} you idiot v{k}", 1), (f"w{k} idiot, he v{k} is", 1), (f"w{k} there was an idiot v{k}", 0), (f"he is not idiot v{k}", 0), (f"w{k} said you idiot v{k}", 0), (f"plain w{k}", 0)]
        return out

    g = x.refitted(spark.createDataFrame(texts(0, 60), "text string, y int"), x.Grammar({"idiot": 4.0}, {}))

    def wrong(factors):
        m = x.Matcher(x.Grammar(g.words, g.stems, g.logit, g.lengths, factors))
        return sum((m.score(t) >= 0.5) != bool(y) for t, y in texts(100, 130))

    assert wrong(g.factors) == 0
    for k in range(3):
        assert wrong(tuple(1.0 if j == k else f for j, f in enumerate(g.factors))) > 0, k


def test_composition_is_deterministic_and_complete():
    table_, n = x.composed()
    assert len(table_) == n and all(set(row) == set(range(7)) and all(0 <= t < n for t, _ in row.values()) for row in table_)


def test_copied_clean_quotes_count_once(spark):
    toxic = [(f"a{k} grobian b{k}", 1) for k in range(40)] + [(f"q{k}", 1) for k in range(60)]
    clean = [("they quote grobian once here", 0)] * 90 + [(f"plain text {k}", 0) for k in range(70)]
    words, _ = x.learned_words(spark.createDataFrame(toxic + clean, "text string, y int"), x.ToxicParams())
    assert set(words) == {"grobian"}


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = {r["doc_id"]: r for r in x.scored(docs, x.learn(docs, labels)).collect()}
    hit = {(a, b): 0 for a in (0, 1) for b in (0, 1)}
    for r in labels.collect():
        o = out[r["doc_id"]]
        assert o["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if o["held_out"]:
            hit[r["toxic"], o["predicted"]] += 1
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) >= 0.9 and hit[0, 1] <= 0.02 * (hit[0, 0] + hit[0, 1])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", 2), (None, None, 2), (1, "a", 2)], "doc_id long, text string, score int")
    g = x.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in x.scored(docs, g).collect()] == [0, 0, 0]
    assert x.scored(docs.limit(0), g).collect() == []


def test_a_threat_keeps_the_weight_of_the_insult_before_it():
    m = x.Matcher(x.Grammar({"idiot": 4.0}, {}))
    aimed, threat = m.clauses("you idiot")[0], m.clauses("will kill")[0]
    assert m.clauses("idiot will kill you") == [pytest.approx(aimed + threat)]
