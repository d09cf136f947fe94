import collections
import re

from tidemark.llm import quality_rules as q

SCHEMA = "doc_id long, text string, n_words string"


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_figures_match_brute_force(spark):
    texts = [None, "", "  ", "a", "a b c", "a a a", "a a a a", "x y z x y z", "é漢 é漢 é漢 é漢", " \x0b lead\n\nlead\nlead \n", "#*$%&|<> 1 A.", "a b c", "r " * 5000, "one two three four one two three five two three four", "a b c d a b c d e f g e f g"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    out = q.judged(docs, [])
    assert "n_words" in out.columns
    got = {r["doc_id"]: (r["_stats"], r["base_failed"], r["kept"]) for r in out.collect()}
    for i, t in enumerate(texts):
        s, failed, kept = got[i]
        assert tuple(s[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t), t
        n, rep = brute(t)[0], brute(t)[4]
        assert failed == (n < 50 or 100 * rep > 50 * n) and kept == (not failed)


def test_learns_thresholds_and_leaves_good_rows(spark):
    good = [(i, " ".join(f"word{i}x{k}" for k in range(60 + i % 50)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{i}%{k}" for k in range(60 + i % 50)), 0) for i in range(150)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in good + bad], SCHEMA)
    labels = spark.createDataFrame([(i, y, None) for i, _, y in good + bad] + [(None, 1, None), (5, None, None), (99999, 0, None)], "doc_id long, quality int, toxic int")
    rules = q.learn(df, labels)
    assert rules and "case" not in rules[0].sql()
    kept = {r["doc_id"] for r in q.judged(df, rules).filter("kept").select("doc_id").collect()}
    assert kept == {i for i, _, _ in good}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert q.learn(df, labels) == [] and q.judged(df.limit(0), []).collect() == []


def test_windows_of_a_very_long_text(spark):
    """Three million words of which one window comes twice; hashes cut short would find more."""
    df = spark.sql("select 1L doc_id, concat('p q r ', array_join(transform(sequence(1, 3000000), x -> hex(x)), ' '), ' p q r') text union all select null, 'a b c d a b c' union all select 7, 'x' union all select 7, 'x'")
    got = sorted((r["_stats"]["n_words"], r["_stats"]["n_repeat_words"]) for r in q.judged(df, []).select("_stats").collect())
    assert got == [(1, 0), (1, 0), (7, 6), (3_000_006, 6)]
