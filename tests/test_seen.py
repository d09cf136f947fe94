"""The bounded set of seen ids against a plain pass over the same micro-batches."""

import collections

import pytest
from pyspark.sql import functions as F

from tests.compare import differences
from tidemark.plans import catalog
from tidemark.sources import io
from tidemark.streaming import runner, seen

SF = "/root/testdata/sf0.001"
START = 1_700_000_000


def brute(batches, delay, keep, limit, clear, bucket):
    held, newest, out = collections.defaultdict(list), None, []
    for rows in batches:
        watermark = (newest - delay) * 1000 if newest is not None else 0
        dealt = collections.defaultdict(list)
        for r in rows:
            dealt[bucket[r[0]]].append(r)
        for b in {*dealt, *held}:
            held[b] = [x for x in held[b] if x[0] + keep * 1000 > watermark]
            known = {i for _, i in held[b]}
            for i, t, note in sorted(dealt[b], key=lambda r: (r[1], str(r))):
                if t * 1000 > watermark and i not in known:
                    known.add(i)
                    held[b].append((t * 1000, i))
                    out.append((i, t, note))
            held[b].sort()
            if len(held[b]) > limit:
                held[b] = [] if clear else held[b][-limit:]
        newest = max([newest or 0, *(r[1] for r in rows)])
    return sorted(out)


BATCHES = [
    # repeated in one batch and over batches, the earliest first
    [("a", START + 50, "x"), ("a", START + 40, "y"), ("b", START + 10, "x"), ("c", START + 20, "x"), ("c", START + 20, "w")],
    [("a", START + 60, "again"), ("d", START + 70, "x"), ("e", START + 71, "x"), ("f", START + 72, "x"), ("g", START + 73, "x")],
    # b may have gone beyond the limit by now, and comes back
    [("b", START + 80, "back"), ("c", START + 81, "back"), ("a", START + 82, "back")],
    # far ahead: the watermark leaves all behind
    [("h", START + 5000, "x")],
    # late ids are dropped, forgotten ones pass
    [("a", START + 90, "late"), ("new", START + 91, "late"), ("a", START + 5001, "forgotten"), ("h", START + 5002, "repeat")],
    [("a", START + 5003, "repeat"), ("b", START + 5004, "x")],
]


@pytest.mark.parametrize(("limit", "clear", "keep", "buckets"), [(1000, False, None, 4), (2, False, None, 2), (2, True, "400 seconds", 2), (3, False, "10 seconds", 1)])
def test_output_equals_a_plain_pass(spark, tmp_path, limit, clear, keep, buckets):
    for k, rows in enumerate(BATCHES):
        path = tmp_path / "in" / f"{k}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(f'{{"id": "{i}", "t": {t}, "note": "{n}"}}\n' for i, t, n in rows))
        import os

        os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))  # files are read in order of their age
    stream = spark.readStream.schema("id string, t long, note string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream = stream.withColumn("ts", F.timestamp_seconds("t"))
    with io.settings(spark, seen.ROCKSDB):
        out = seen.unseen(stream, "id", "100 seconds", keep=keep, limit=limit, clear=clear, buckets=buckets)
        runner.run(out, {"out": lambda b: b}, str(tmp_path), f"{tmp_path}/c", "append").awaitTermination()
    got = sorted((r["id"], r["t"], r["note"]) for r in runner.appended(spark, f"{tmp_path}/out", out.schema).collect())
    ids = sorted({i for rows in BATCHES for i, _, _ in rows})
    bucket = {r["id"]: r["b"] for r in spark.createDataFrame([(i,) for i in ids], "id string").select("id", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("b")).collect()}
    want = brute(BATCHES, 100, int(keep.split()[0]) if keep else 100, limit, clear, bucket)
    assert got == want
    # what a stream without the set passes on is another result
    assert len(want) < sum(map(len, BATCHES))


def test_query_fails_when_nothing_is_deduplicated(spark, monkeypatch):
    assert not differences(catalog.QUERIES["st_dedup"](spark, SF), catalog.SQL["st_dedup"], SF)
    monkeypatch.setattr(seen, "unseen", lambda rows, *_, **__: rows)
    assert differences(catalog.QUERIES["st_dedup"](spark, SF), catalog.SQL["st_dedup"], SF)
