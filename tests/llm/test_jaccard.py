import re
from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as entry
from tidemark.llm import jaccard
from tidemark.llm.common import table

SCHEMA = "doc_id long, text string, row int, n string"


def grams(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, percent=80):
    """Rows of (doc_id, n, component), by the overlaps of all pairs."""
    rows = [r for r in rows if r[0] is not None]
    sets = [grams(t) for _, t in rows]
    holds = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holds[x].append(k)
    both = [Counter() for _ in rows]
    for ks in holds.values():
        for n, a in enumerate(ks):
            both[a].update(ks[:n])
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for a, c in enumerate(both):
        for b, n in c.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i, len(sets[k]), least[top(k)]) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def edited(rng, words, share):
    w = list(words)
    for k in range(len(w)):
        if rng.random() < share:
            w[k] = f"e{rng.integers(10**6)}"
    return " ".join(w)


def rows(seed, n=40):
    rng = np.random.default_rng(seed)
    vocabulary = [f"W{i}" for i in range(3000)]
    common = list(rng.choice(vocabulary, 60))
    out = []
    for k in range(n):
        size = int(rng.choice([1, 3, 4, 5, 6, 7, 9, 12, 20, 30, 60, 150, 400]))
        base = list(rng.choice(vocabulary, size)) + (common if k % 3 == 0 else [])
        # graded copies: chains whose ends are far apart
        for _ in range(int(rng.integers(1, 6))):
            base = edited(rng, base, float(rng.choice([0, 0.01, 0.02, 0.04]))).split()
            out.append(" ".join(base + (list(rng.choice(vocabulary, int(size * 0.1))) if rng.random() < 0.3 else [])))
    whole = list(rng.choice(vocabulary, 300))
    out += [edited(rng, whole, 0.012) for _ in range(60)] + [" ".join(whole)] * 5
    # few common lines in many orders: similar, or nearly so
    lines = [" ".join(rng.choice(vocabulary, 25)) for _ in range(6)]
    out += ["\n".join(rng.permutation(lines)[: int(rng.integers(3, 7))]) for _ in range(50)]
    out += [None, "", " \t", None, "one", "ONE", "one two", "a b c d", "long " * 30000, "Ünï cödé ÀB x y z"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(out)), out)]


def test_graded_copies_match_all_pairs(spark, monkeypatch):
    data = rows(1)
    df = spark.createDataFrame([(*r, 1, "x") for r in data], SCHEMA)
    want = brute(data)
    assert len({c for _, _, c in want}) < len(want) * 0.7
    assert got(jaccard.linked(df)) == want
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    # without anchors the lists alone find every link, with all sets heavy, and with light ones too
    monkeypatch.setattr(jaccard, "MOST_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "SHORT", 5)
    for at in (-1, 30):
        monkeypatch.setattr(jaccard, "boundary", lambda costs, at=at: at)
        assert got(jaccard.linked(df)) == want


def test_whole_table_matches_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    data = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert got(entry.queries()["op11_jaccard"](spark, folder)) == brute(data)


def test_odd_rows(spark):
    data = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text of its own here"), (None, "a b c d e f"), (9, "A B C D E F"), (3, "other text of its own here"), (4, None), (4, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], SCHEMA)
    assert got(jaccard.linked(df)) == [(1, 2, 1), (1, 2, 1), (1, 2, 1), (3, 2, 1), (4, 0, 4), (4, 0, 4), (9, 2, 1)]
    assert got(jaccard.linked(df.limit(0))) == []


def test_boundary_is_where_both_cost_least():
    costs = [(8, 10, 100), (16, 50, 60), (24, 500, 80), (32, 5000, 90)]
    assert jaccard.boundary(costs) == 16 and jaccard.boundary([]) == -1 and jaccard.boundary([(5, 10, 1)]) == -1
    for n in range(2, 400):
        for m in range(n, n * 100 // 80 + 1):
            both = -(-80 * (n + m) // 180)
            assert both >= max(jaccard.least(n, 80), jaccard.least(m, 80)) >= 2


def test_kept_shingles_meet(spark):
    # needs, as Spark works them out, are what the smallest partner spares
    got = spark.range(2, 3000).select("id", jaccard.need(jaccard.F.col("id"), 80).alias("need")).collect()
    assert all(r["need"] == jaccard.spare(jaccard.least(r["id"], 80), 80) for r in got)
