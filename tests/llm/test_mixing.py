import random

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, rank string"


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) for s in full} | t
        full |= over


def test_targets_and_takes(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 80), rng.choice(["hot"] * 8 + ["a", "b", "Z", "é", None]), "r") for i in range(400)]
    rows += [(400, None, "a", "r"), (401, "  \n", "b", "r"), (402, "x " * 3000, "b", "r"), (403, "tiny", "zz", "r"), (5, rows[5][1], rows[5][2], "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    params = mixing.MixParams(bucket_rows=50)
    got = mixing.mix(df, params).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    source = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * want[s] + 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(7), params).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_many_sources(spark):
    """More sources than a bucket or a coarse cell holds, with sizes and ties of all kinds."""
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 7, 7, 40, 500]), f"s{i % 1500}", "r") for i in range(3000)] + [(3000 + i, "w " * 60, "hot", "r") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes, taken, source = {}, {}, {}
    for i, t, s, _ in rows:
        source[i], sizes[s] = s, sizes.get(s, 0) + t.count("w")
    want = filled(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert abs(r["target"] - want[s]) < 1e-6 * want[s] + 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_null_and_repeated_ids_are_taken_by_row(spark):
    ids = [None, None, None, *[7] * 6, *range(10, 40)]
    rows = [(i, f"row{k} " * (5 + k % 4 * 20), "ab"[k % 2], "r") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(r["doc_id"], r["size"]) for r in mixing.mix(df).collect() for _ in range(int(r["taken"] / r["size"] + 0.5))]
    got = [(r["doc_id"], len(r["text"].split())) for r in mixing.mixed(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and any(i is None for i, _ in got)


def test_schedule_follows_the_targets(spark):
    goals = spark.createDataFrame([(0, 600.0), (1, 300.0), (2, 100.0)], "rank int, target double")
    slots = mixing.schedule(spark, goals, 10, 100).collect()
    for k, n in ((0, 600), (1, 300), (2, 100)):
        own = sorted((r["lo"], r["hi"]) for r in slots if r["rank"] == k)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []
    one = spark.createDataFrame([(1, "", None, "r")], SCHEMA)
    assert [tuple(r)[:2] for r in mixing.mix(one).collect()] == [(1, 0)]
