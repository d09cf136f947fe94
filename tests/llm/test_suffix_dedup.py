import hashlib

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as s


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_is_the_suffix_array(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 4, 5, 17, 200):
        t = rng.integers(1, 3 if seed % 2 else 20, n)
        order, _ = s.suffix_order(t, 12)
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("seed", range(4))
def test_suffix_order_holds_as_far_as_names_go(seed):
    rng = np.random.default_rng(seed)
    t = np.concatenate([np.tile(rng.integers(1, 3, int(rng.integers(1, 60))), 30) for _ in range(20)])
    order, _ = s.suffix_order(t, 3)
    assert sorted(order.tolist()) == list(range(len(t)))
    heads = [t[i : i + 27].tolist() for i in order]
    assert heads == sorted(heads)


@pytest.mark.parametrize("hot", [s.HOT, 2])
def test_removal_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(s, "PIECE", 500)
    monkeypatch.setattr(s, "HOT", hot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37 if hot == 2 else 10_000)
    rng = np.random.default_rng(7)
    words = ["alpha", "beta", "gamma", "dé", "of", "the", "漢字"]
    text = lambda n: " ".join(rng.choice(words, n))
    passage = [text(60) for _ in range(4)]
    rows = []
    for i in range(80):
        t = text(int(rng.integers(0, 120)))
        for p in rng.choice(4, int(rng.integers(0, 3)), replace=False):
            a, b = sorted(rng.integers(0, len(passage[p]), 2))
            t = t[: len(t) // 2] + passage[p][a:b] + t[len(t) // 2 :]
        rows.append((i, t))
    for i in range(20):  # near copies
        t = rows[i][1]
        k = int(rng.integers(0, max(1, len(t))))
        rows.append((100 + i, t[:k] + "#" + t[k + 1 :]))
    rows += [(200, rows[5][1]), (201, None), (202, ""), (203, "a" * 400), (204, "a" * 100), (205, "ab" * 200), (206, passage[0] * 40)]
    hits = []
    singly = s._singly
    monkeypatch.setattr(s, "_singly", lambda r, n: hits.append(r.count()) or singly(r, n))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in s.report(spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, doc string")).collect()}
    assert got == brute(rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (hits[0] > 0) == (hot == 2)


def test_lengths_and_odd_rows(spark):
    for n in (31, 244):
        with pytest.raises(ValueError):
            s.Blocks(n)
    t = "".join(chr(97 + int(k)) for k in np.random.default_rng(1).integers(0, 26, 150))
    got = sorted(tuple(r)[:3] for r in s.report(spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")).collect())
    assert got == [(1, 150, 0), (1, 150, 0), (2, 150, 150)]


def test_empty(spark):
    assert s.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
