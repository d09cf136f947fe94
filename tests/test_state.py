"""Snapshots of stream state: folding epochs, crashes between its steps, and outputs that hold still."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import io
from tidemark.streaming import runner

KEYS = ["k"]


def epoch(spark, path, n, rows):
    io.write_epoch(spark.createDataFrame(rows, "k string, v long"), path, n)


def read(spark, path):
    schema = spark.createDataFrame([], "k string, v long").schema
    return {r["k"]: r["v"] for r in runner.state(spark, path, KEYS, schema).collect()}


def files(spark, path):
    schema = spark.createDataFrame([], "k string, v long").schema
    return {f.rsplit("/", 2)[1] for f in runner.state(spark, path, KEYS, schema).inputFiles()}


def test_reads_touch_the_snapshot_and_later_epochs_alone(spark, tmp_path):
    path, want = str(tmp_path / "o"), {}
    assert read(spark, path) == {} and runner.compact(spark, path, KEYS) is None
    for n in range(7):
        rows = [(f"k{(n * i) % 5}", n) for i in range(3)]
        want |= dict(rows)
        epoch(spark, path, n, rows)
        if n in (3, 5):
            assert runner.compact(spark, path, KEYS) == n - 1
        assert read(spark, path) == want
    assert files(spark, path) == {"upto=4", "epoch=5", "epoch=6"}
    # a replayed newest epoch replaces itself
    epoch(spark, path, 6, [("k0", 60)])
    assert read(spark, path) == {**{k: v for k, v in want.items() if v < 6}, "k0": 60, **({k: read(spark, path)[k] for k in want if want[k] == 6 and k != "k0"})}
    assert runner.compact(spark, path, KEYS) == 5 and runner.compact(spark, path, KEYS) is None and files(spark, path) == {"upto=5", "epoch=6"}


@pytest.mark.parametrize("step", ["write", "rename", "remove"])
def test_a_crash_between_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "o")
    for n in range(4):
        epoch(spark, path, n, [("a", n), (f"k{n}", n)])
    runner.compact(spark, path, KEYS)
    for n in (4, 5):
        epoch(spark, path, n, [("a", n), (f"k{n}", n)])
    want = read(spark, path)

    class Crash(Exception):
        pass

    def crash(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        if step == "write":  # after part of the snapshot has been written
            write = runner._last
            m.setattr(runner, "_last", lambda *a: write(*a).withColumn("v", F.when(F.col("k") == "a", F.raise_error(F.lit("crash"))).otherwise(F.col("v"))))
        elif step == "rename":
            folder = runner._folder
            m.setattr(runner, "_folder", lambda s, p: crash() if "upto=4" in p and not p.endswith("_SUCCESS") else folder(s, p))
        else:
            m.setattr(runner, "_removed", crash)
        with pytest.raises(Exception):
            runner.compact(spark, path, KEYS)
    assert read(spark, path) == want
    runner.compact(spark, path, KEYS)
    assert read(spark, path) == want and files(spark, path) == {"upto=4", "epoch=5"}


def test_stream_folds_its_epochs_and_second_output_holds_still(spark, tmp_path):
    for n, v in enumerate([5, 20, 3, 1, 1, 30]):
        spark.createDataFrame([("a", v), (f"b{n % 2}", 8)], "k string, v long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).groupBy("k").agg(F.sum("v").alias("v"))
    # keys of a total between 8 and 50: a rises above it later, and its old rows must not hold
    outputs = {"all": lambda b: b, "some": lambda b: b.filter("v between 8 and 50")}
    runner.run(stream, outputs, str(tmp_path), f"{tmp_path}/c", compacted={"all": KEYS}, epochs=2).awaitTermination()
    assert len(runner._parts(spark, f"{tmp_path}/all")[1]) <= 3 and runner._parts(spark, f"{tmp_path}/all")[0] is not None
    rows = runner.state(spark, f"{tmp_path}/all", KEYS, stream.schema, epoch=True)
    assert {r["k"]: r["v"] for r in rows.collect()} == {"a": 60, "b0": 24, "b1": 24}
    assert {r["k"]: r["v"] for r in runner.current(spark, f"{tmp_path}/some", KEYS, stream.schema, rows).collect()} == {"b0": 24, "b1": 24}


def test_epochs_are_folded_once_they_hold_as_much_as_the_snapshot(spark, tmp_path):
    path = str(tmp_path)
    due = []
    for n in range(5):
        # the first epoch is many times as large as those after it
        epoch(spark, path, n, [(f"k{n}-{i}-{i * 7919 % 10007}", i) for i in range(20_000 if n == 0 else 10)])
        due.append(runner._due(spark, path, 1))
        if n == 1:
            runner.compact(spark, path, KEYS)
    assert due == [False, True, False, False, False]
    epoch(spark, path, 5, [(f"k5-{i}-{i * 7919 % 10007}", i) for i in range(40_000)])
    assert not runner._due(spark, path, 1)  # the newest isn't folded
    epoch(spark, path, 6, [("k", 1)])
    assert runner._due(spark, path, 1) and runner.compact(spark, path, KEYS) == 5 and len(read(spark, path)) == 60_041


def test_state_of_aggregates_lies_on_disk(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    for n in range(3):
        spark.createDataFrame([("a", n), (f"b{n}", 1)], "k string, v long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).groupBy("k").agg(F.sum("v").alias("v"))
    q = runner.run(stream, {"out": lambda b: b}, str(tmp_path), f"{tmp_path}/c")
    q.awaitTermination()
    # a heap that holds the state grows with its keys
    assert "rocksdbPutCount" in q.lastProgress["stateOperators"][0]["customMetrics"]
    assert spark.conf.get(provider, None) == before
    schema = stream.schema
    assert {r["k"]: r["v"] for r in runner.state(spark, f"{tmp_path}/out", KEYS, schema).collect()} == {"a": 3, "b0": 1, "b1": 1, "b2": 1}


def test_last_epochs_read_keys_alone(spark, tmp_path):
    path, schema = str(tmp_path / "o"), spark.createDataFrame([], "k string, v long").schema
    assert runner.last_epochs(spark, path, KEYS, schema).collect() == []
    for n in range(5):
        epoch(spark, path, n, [(f"k{(n * i) % 4}", n) for i in range(3)])
        if n == 2:
            runner.compact(spark, path, KEYS)
    got = runner.last_epochs(spark, path, KEYS, schema)
    want = runner.state(spark, path, KEYS, schema, epoch=True)
    assert sorted(got.collect()) == sorted(want.select("k", "epoch").collect()) and got.columns == ["k", "epoch"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "v:bigint" not in plan and "Sort" not in plan
