import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from tidemark.llm import variants
from tidemark.llm.common import table

SCHEMA = "doc_id long, text string, n int, word string"


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}
    # words with one error between them share what is left without some code point, or one is that
    left = {}
    for w in n:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            left.setdefault(x, set()).add(w)
    near = {w: set() for w in n}
    for ws in left.values():
        for a in ws:
            near[a] |= {b for b in ws if one_error(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table_matches_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    want = brute([tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()])
    assert got(entry.queries()["op13_variants"](spark, folder)) == want and sum(w[1] is not None for w in want) > 10


def test_dense_words_and_cut_anchors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcéÿ"))
    words = {"".join(rng.choice(letters[: 2 + i % 4], int(rng.integers(6, 10)))) for i in range(500)} | {"a" * k for k in range(6, 14)} | {"z" * 3000, "z" * 3001, "abcabc" + "q" * 40}
    rows = [(i, " ".join([w] * int(rng.choice([4, 5, 6, 30, 200]))), 1, "x") for i, w in enumerate(sorted(words))]
    rows += [(None, "NullÉid nullÉid NULLÉID " * 5, 1, "x"), (3, None, 1, "x"), (4, "", 1, "x"), (5, "abcdef", 1, "x"), (5, "abcdef", 1, "x"), (7, "×÷abcde " * 6, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r[:2] for r in rows])
    assert got(variants.grouped(df)) == want and any(w[4] > 5 for w in want)
    monkeypatch.setattr(variants, "SHARD", 20)
    monkeypatch.setattr(variants, "HELD_TERMS", 30)
    monkeypatch.setattr(variants, "UNFOLDED", 50)
    assert got(variants.grouped(df)) == want
    assert got(variants.grouped(df.limit(0))) == set()


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "w3")]
    got = {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w21" for w, _ in chain}


def test_search_goes_by_suffix_ranks():
    words = ["banana", "banane", "bananas", "anana", "canana", "bannana"]
    index = variants.Index(words)
    for larger in (False, True):
        a, b = variants.near(index, words, larger)
        # errors in front of the exact last half alone
        half = {x: x[(len(x) + larger) // 2 :] for x in words}
        assert {(words[x], words[y]) for x, y in zip(a, b)} == {(x, y) for x in words for y in words if one_error(x, y) and y.endswith(half[x])}
