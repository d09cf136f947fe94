"""Versions behind gates, tables that change under a stream, and JDBC parts of near equal size."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.sources import io, versions
from tidemark.streaming import runner


def test_gates_are_counted_while_writing_and_stop_the_commit(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    spark.range(100).write.parquet(source)
    df = spark.read.parquet(source)
    gates = {"rows": (F.lit(True), 1), "even": (F.col("id") % 2 == 0, 50)}
    assert versions.publish(df, path, gates, [source]) == [("rows", 100, True), ("even", 50, True)]
    with pytest.raises(versions.GateError) as e:
        versions.publish(df.filter("id < 50"), path, gates)
    assert e.value.gates == [("rows", 50, True), ("even", 25, False)]
    with pytest.raises(FileNotFoundError):
        versions.publish(df, path, gates, [str(tmp_path / "none*")])
    assert versions.numbers(spark, path) == [1] and versions.read(spark, path).count() == 100
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_writing")]
    assert versions.publish(df.withColumn("k", F.col("id") % 3), path, gates, partition_by=("k",)) and versions.publish(df.limit(0), path) == []
    assert versions.numbers(spark, path) == [1, 2, 3] and versions.read(spark, path, 2).count() == 100
    assert versions.prune(spark, path, 1) == [1, 2] and versions.read(spark, path).count() == 0
    plan = versions.observed(df, gates, Observation())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan


def test_a_failed_write_leaves_the_newest_version(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.publish(spark.range(3), path)
    with pytest.raises(Exception):
        versions.publish(spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("x")), path, {"rows": (F.lit(True), 1)})
    assert versions.numbers(spark, path) == [1] and versions.read(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))


def test_a_table_changes_under_a_stream_and_replays_read_what_they_read(spark, tmp_path):
    rate, folder, source = (str(tmp_path / n) for n in ("rate", "out", "in"))
    one = lambda by: spark.createDataFrame([("a", by)], "k string, by long")
    versions.publish(one(10), rate)
    for n in (1, 2, 3):
        spark.createDataFrame([(n,)], "v long").coalesce(1).write.mode("append").json(source)
    crash, runs = {1}, []

    def priced(batch, rate):
        return batch.crossJoin(rate).select((F.col("v") * F.col("by")).alias("v"), "by")

    def after(batch, rate):
        runs.append(1)
        if len(runs) == 1:  # published between micro-batches of a running stream
            versions.publish(one(20), str(tmp_path / "rate"))
        if len(runs) == 2 and crash:  # the second epoch stops after its first output, and a third version comes
            crash.clear()
            versions.publish(one(30), str(tmp_path / "rate"))
            raise RuntimeError("lost")
        return batch.select("v")

    def start():
        stream = spark.readStream.schema("v long").option("maxFilesPerTrigger", 1).json(source)
        return runner.run(stream, {"priced": priced, "after": after}, folder, str(tmp_path / "check"), mode="append", past={"rate": rate})

    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    used = {r["epoch"]: r["version"] for r in runner.used_versions(spark, folder).collect()}
    assert used == {0: 1, 1: 2, 2: 3}  # the replayed epoch kept its version
    got = runner.appended(spark, f"{folder}/priced", spark.createDataFrame([], "v long, by long").schema).collect()
    assert sorted(r["by"] for r in got) == [10, 20, 30] and {r["v"] // r["by"] for r in got} == {1, 2, 3}
    with pytest.raises(FileNotFoundError):
        runner._pinned(spark, folder, 9, {"rate": str(tmp_path / "none")})


@pytest.mark.parametrize("kind", ["long", "double"])
def test_a_skewed_table_is_read_in_near_equal_parts(spark, tmp_path, kind):
    url = f"jdbc:derby:memory:v{kind}{tmp_path.name.replace('-', '').replace('_', '')};create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    # most keys close together, a few far away, one that a quarter of all rows hold, and some without
    key = F.when(F.col("id") < 250, 7).when(F.col("id") < 990, F.col("id")).when(F.col("id") < 995, F.col("id") * 1_000_000_000)
    io.write_jdbc(spark.range(1000).select("id", key.cast(kind).alias("k")), url, "t", driver)
    parts = io.jdbc_parts(spark, url, "t", '"k"', 8, driver)
    df = io.read_jdbc(spark, url, "t", driver, even=('"k"', 8))
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert df.count() == 1000 and df.select("id").distinct().count() == 1000
    assert len(parts) <= 10 and df.rdd.getNumPartitions() == len(parts)
    assert max(s for s in sizes if s < 250) <= 160 and sum(s >= 250 for s in sizes) == 1 and max(sizes) <= 260
    assert "PushedFilters: [" in (plan := df.filter("k > 500")._jdf.queryExecution().executedPlan().toString()) and "GreaterThan(k,500" in plan
    empty = spark.createDataFrame([], f"k {kind}")
    io.write_jdbc(empty, url, "e", driver)
    assert io.jdbc_parts(spark, url, "e", '"k"', 4, driver) == ["1 = 1"] and io.read_jdbc(spark, url, "e", driver, even=('"k"', 4)).count() == 0
