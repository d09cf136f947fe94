import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import TABLES, differences
from tidemark.plans import adapters, catalog
from tidemark.sources import io
from tidemark.streaming import runner, trends

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_state_equals_batch(spark, parts, tmp_path):
    data = adapters.events(spark, SF)
    io.to_envelope(data, "t", "timestamp").repartition(parts).write.text(f"{tmp_path}/in")
    stream = io.read_stream(spark, "text", {"path": f"{tmp_path}/in", "maxFilesPerTrigger": 1}, trends.MESSAGE)
    agg = trends.category_agg(trends.trending_features(stream), "1 day", "12 hours", "100 days")
    runner.run(agg, {"out": lambda b: b}, str(tmp_path), f"{tmp_path}/c").awaitTermination()
    schema = spark.read.parquet(f"{tmp_path}/out").drop("epoch").schema
    got = runner.state(spark, f"{tmp_path}/out", ["window", "category"], schema)
    table = spark.read.text(f"{tmp_path}/in").select(F.from_json("value", trends.MESSAGE).alias("m")).select("m.*").withColumn("ts", F.timestamp_seconds("timestamp"))
    want = trends.category_agg(trends.trending_features(table), "1 day", "12 hours", None)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()


def test_late_rows_are_dropped(spark, tmp_path):
    on_time = [(i, 1_700_000_000 + 60 * i, "10") for i in range(30)]
    late = [(99, 1_600_000_000, "10")]
    for name, rows in (("a", on_time), ("b", on_time[-1:]), ("c", late)):
        df = spark.createDataFrame(rows, "id int, timestamp long, viewCount string").withColumn("category", F.lit("x"))
        io.to_envelope(df.drop("id"), "t", "timestamp").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        stream = io.read_stream(spark, "text", {"path": f"{tmp_path}/in"}, trends.MESSAGE)
        agg = trends.category_agg(trends.trending_features(stream), "10 minutes", "10 minutes", "1 minute")
        runner.run(agg, {"out": lambda b: b}, str(tmp_path), f"{tmp_path}/c").awaitTermination()
    starts = [r[0] for r in spark.read.parquet(f"{tmp_path}/out").select(F.unix_seconds("window.start")).distinct().collect()]
    assert starts and min(starts) > 1_650_000_000


def test_messages_are_parsed_once(spark, tmp_path):
    data = adapters.events(spark, SF)
    io.to_envelope(data, "t", "timestamp").union(spark.createDataFrame([("",), ("no message",), ("null",), ("{}",)], "value string")).write.text(f"{tmp_path}/in")
    of = {
        trends.MESSAGE: lambda m: trends.dominance_agg(trends.trending_features(m), "1 day", "100 days"),
        trends.DETAILS: lambda m: trends.category_agg(trends.details_features(m), "1 day", "12 hours", "100 days"),
    }
    for schema, report in of.items():
        stream = io.read_stream(spark, "text", {"path": f"{tmp_path}/in"}, schema)
        plan = spark._jvm.PythonSQLUtils.explainString(report(stream)._jdf.queryExecution(), "extended")
        assert plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("from_json(") == 1
    every = trends.trending_features(io.read_stream(spark, "text", {"path": f"{tmp_path}/in"}, trends.MESSAGE))
    runner.run(every, {"out": lambda b: b}, str(tmp_path), f"{tmp_path}/c", "append").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == data.filter(F.regexp_replace("viewCount", "[^0-9]", "").try_cast("bigint") > 0).count() > 0


def test_without_history(spark):
    m = adapters.events(spark, SF).select(F.col("timestamp"), F.struct("*").alias("data")).withColumn("ts", F.timestamp_seconds("timestamp"))
    f = trends.trending_features(m)
    assert "performance_trend" not in trends.title_strategy(trends.title_features(f), None, "1 day").columns
    assert trends.tag_momentum(trends.tag_features(f), None, "1 day").count() > 0
    golden = adapters.golden(spark, SF)
    h = catalog.history.channel_history(golden)
    none = h.limit(0)
    labels = {r[0] for r in trends.channel_anomaly(trends.channel_agg(f, "1 day"), none).select("performance_vs_history").distinct().collect()}
    assert labels == {"New Channel"}
    assert trends.channel_viral(trends.channel_anomaly(trends.channel_agg(f, "1 day"), h)).columns[-1] == "tier"
    assert trends.dominance_anomalies(trends.dominance_score(trends.dominance_agg(f, "1 day", None), catalog._tops(golden))).columns[-1] == "popularity_tier"


STREAMS = [name for name in catalog.QUERIES if name.startswith("s") and name[1].isdigit()]


@pytest.mark.parametrize("name", [*STREAMS, "st_dedup"])
def test_reports_do_not_depend_on_micro_batches(spark, name, monkeypatch):
    def four(spark, folder, data, schema):
        io.to_envelope(data, "test", "timestamp").repartition(4).write.text(f"{folder}/in")
        return io.read_stream(spark, "text", {"path": f"{folder}/in", "maxFilesPerTrigger": 1}, schema)

    runs = []
    run = runner.run
    monkeypatch.setattr(catalog, "_messages", four)
    monkeypatch.setattr(runner, "run", lambda *a, **k: runs.append(run(*a, **k)) or runs[-1])
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() > 0 and not differences(df, catalog.SQL[name], SF)
    assert len([p for p in runs[0].recentProgress if p["numInputRows"]]) == 4


@pytest.mark.parametrize("name", [*STREAMS, "st_dedup", "st_envelope"])
def test_without_events(spark, name, tmp_path):
    for t in ("lineitem", "orders", "customer", "nation", "part", "documents"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SF}/events.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert df.collect() == [] and set(df.columns) == set(catalog.QUERIES[name](spark, SF).columns)


@pytest.mark.parametrize("name", ["s1_anomalies", "s1_dominance"])
def test_messages_without_a_type_are_reported(spark, name, tmp_path):
    for t in TABLES:
        if t != "events":
            shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert not differences(catalog.QUERIES[name](spark, str(tmp_path)), catalog.SQL[name], str(tmp_path))


def test_processing_time_trigger(spark, tmp_path):
    """A stream on a timer goes on until it is stopped, with its outputs in order."""
    data = adapters.events(spark, SF)
    io.to_envelope(data, "t", "timestamp").coalesce(1).write.text(f"{tmp_path}/in")
    stream = trends.trending_features(io.read_stream(spark, "text", {"path": f"{tmp_path}/in"}, trends.MESSAGE))
    q = runner.run(stream, {"all": lambda b: b.orderBy(F.desc("views")), "few": lambda b: b.limit(5)}, str(tmp_path), f"{tmp_path}/c", "append", "1 second")
    try:
        q.processAllAvailable()
        assert q.isActive
        runner.await_any(spark, 1)
    finally:
        q.stop()
    views = [r["views"] for r in spark.read.parquet(f"{tmp_path}/all/epoch=0").collect()]
    assert views == sorted(views, reverse=True) and len(views) == data.count() and spark.read.parquet(f"{tmp_path}/few/epoch=0").count() == 5
