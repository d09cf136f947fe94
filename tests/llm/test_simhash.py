import re

import numpy as np
import xxhash

from tidemark.llm import simhash

SCHEMA = "doc_id long, text string, n_chars string"


def brute(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def groups(fps, budget=4):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_fingerprints_and_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"W{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 60, 60)]
    for t in texts[:25]:  # near copies
        w = t.split()
        if w:
            w[int(rng.integers(len(w)))] = "Changed"
        texts.append(" ".join(w))
    texts += [None, "", " \t", "one", "ONE", "Ünï cödé ÀB", texts[3], texts[3], "long " * 30000]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    want_fp = {i: brute(t) for i, t, _ in rows}
    want = groups(want_fp)
    got = {r["doc_id"]: r for r in simhash.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in want_fp.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64) * 2]
    fps = set(base)
    for x in base:
        for n in (1, 2, 3, 4, 4, 5):
            y = x
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = {i: x for i, x in enumerate(sorted(fps))}
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    for front, budget in ((1, 4), (10, 4), (8, 8)):
        got = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, budget, front)).collect()}
        assert {i: got.get(i, i) for i in fps} == groups(fps, budget)


def test_wide_links_count_if_the_texts_are_similar(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for n in (1, 2, 3, 40, 60):
        w = list(base)
        for k in rng.choice(120, n, replace=False):
            w[k] = f"x{n}y{k}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, wide=8).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    fps = {i: brute(t) for i, t in enumerate(texts)}
    near = {(i, j) for i in fps for j in fps if i < j and ((d := (fps[i] ^ fps[j]).bit_count()) <= 4 or d <= 8 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))}
    up = {i: i for i in fps}
    for _ in fps:
        for i, j in near:
            up[i] = up[j] = min(up[i], up[j])
    assert got == up and len(near) > 0


def joined(ids, near):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in near:
        a, b = top(i), top(j)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def similar_pairs(texts, least=0.8):
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in texts]
    return {(i, j) for i, p in enumerate(sets) for j, q in enumerate(sets[:i]) if (n := len(p & q)) >= least * (len(p) + len(q) - n)}


def test_similar_texts_far_apart_are_linked(spark):
    rng = np.random.default_rng(5)
    texts = []
    for g in range(150):  # similarity just over 0.8
        w = [f"g{g}w{i}" for i in range(150)]
        texts.append(" ".join(w))
        for k in rng.choice(np.arange(5, 145), 3, replace=False):
            w[k] = f"g{g}x{k}"
        texts.append(" ".join(w))
    fps = [brute(t) for t in texts]
    near = similar_pairs(texts)
    beyond = [(i, j) for i, j in near if (fps[i] ^ fps[j]).bit_count() > 8]
    assert len(beyond) > 10
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, wide=64).collect()}
    close = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    assert got == joined(range(len(texts)), near | close)


def test_graded_copies_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 20, raising=False)  # several blocks for each group
    rng = np.random.default_rng(6)
    texts = []
    for g in range(8):
        for _ in range(100):
            w = [f"g{g}w{i}" for i in range(150)]
            for k in rng.choice(150, int(rng.integers(1, 9)), replace=False):
                w[k] = f"x{rng.integers(1 << 40)}"
            texts.append(" ".join(w))
    fps = [brute(t) for t in texts]
    bits = {(i, j): (fps[i] ^ fps[j]).bit_count() for i in range(len(fps)) for j in range(i)}
    near = {p for p in similar_pairs(texts) if bits[p] <= 8} | {p for p, n in bits.items() if n <= 4}
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, wide=8).collect()}
    assert got == joined(range(len(texts)), near)


def test_walk_joins_every_pair_of_dense_groups():
    rng = np.random.default_rng(3)
    for most in (1, 0):
        near = [sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) ^ int(c) for c in rng.integers(0, 1 << 63, 5, dtype=np.uint64) >> 3 for k in rng.integers(1, 6, 150)]
        leaves = np.unique(np.array(near, np.uint64))
        linked = [(i, j) for i in range(len(leaves)) for j in range(i) if (d := int(leaves[i] ^ leaves[j])).bit_count() <= 4 and (d >> 43).bit_count() <= most]
        got = simhash.Joined(len(leaves))
        simhash._walk(leaves, (0, len(leaves)), (0, len(leaves)), 0, 21, most, 4, got, block=1 << 8)
        assert dict(enumerate(got.up.tolist())) == joined(range(len(leaves)), linked) and len(linked) > 500


def test_groups_in_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(8)
    fps = sorted({sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(1, 5, 300)} | {int(x) for x in rng.integers(0, 1 << 63, 100, dtype=np.uint64)})
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, 4, 4, block=50)).collect()}
    assert {i: got.get(i, i) for i in range(len(fps))} == groups(dict(enumerate(fps)))


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e", "x"), (2, "a b c d e", "x"), (2, "a b c d e", "x"), (1, "A b c d e", "x"), (3, None, "x"), (4, "", "x")]
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.report(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_empty(spark):
    assert simhash.report(spark.createDataFrame([], SCHEMA)).collect() == []
