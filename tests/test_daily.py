"""Histories that are kept up by day against the same worked out anew."""

from pyspark.sql import functions as F

from tidemark.operators import daily, history
from tidemark.plans import adapters

SF = "/root/testdata/sf0.001"


def rows(spark, tmp_path):
    g = adapters.golden(spark, SF).filter(F.col("trending_full_date").between("1996-01-01", "1996-01-31"))
    g.write.partitionBy("trending_full_date").parquet(str(tmp_path / "golden"))
    return spark.read.parquet(str(tmp_path / "golden"))


def close(a, b):
    return a == b or isinstance(a, float) and abs(a - b) <= 1e-9 * max(1, abs(b))


def same(a, b, keys):
    a, b = ({tuple(r[k] for k in keys): r for r in df.select(*b.columns).collect()} for df in (a, b))
    return a.keys() == b.keys() and all(close(x, y) for k in a for x, y in zip(a[k], b[k]))


def test_one_added_day_equals_a_recomputation_and_reads_that_day(spark, tmp_path):
    g, path, keys = rows(spark, tmp_path), str(tmp_path / "store"), daily.CHANNELS.keys
    last = g.agg(F.max("trending_full_date")).first()[0]
    daily.add(daily.partials(g.filter(F.col("trending_full_date") < F.lit(last)), daily.CHANNELS), path)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    new = g.filter(F.col("trending_full_date") == F.lit(last))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trending_full_date" in plan
    daily.add(daily.partials(new, daily.CHANNELS), path)
    store = daily.read(spark, path)
    # other days' files stay as they were
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) > len(before)
    assert same(daily.channel_history(store), history.channel_history(g, "full"), keys)
    # groups are small, so that sketches hold all their values
    assert same(daily.channel_intelligence(store), history.channel_intelligence(g), keys)
    # the same day again replaces itself, and a corrected one counts as corrected
    daily.add(daily.partials(new, daily.CHANNELS), path)
    assert same(daily.channel_history(daily.read(spark, path)), history.channel_history(g, "full"), keys)
    daily.add(daily.partials(new.withColumn("views", F.col("views") + 1), daily.CHANNELS), path)
    fixed = g.withColumn("views", F.when(F.col("trending_full_date") == F.lit(last), F.col("views") + 1).otherwise(F.col("views")))
    assert same(daily.channel_history(daily.read(spark, path)), history.channel_history(fixed, "full"), keys)


def test_merged_sketches_stay_within_their_errors(spark):
    g = spark.range(60_000).select(
        F.lit("c").alias("category_title"), F.lit("r").alias("region"), F.concat(F.lit("ch"), F.col("id") % 20_000).alias("channel_title"), F.lit("t").alias("tag"), F.lit(True).alias("comments_disabled"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) + 1).alias("views"), F.lit(5).cast("long").alias("likes"), F.lit(1).cast("long").alias("comment_count"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")).alias("trending_full_date"),
    )
    store = daily.partials(g, daily.TAGS)
    assert store.count() == 60
    out = daily.tag_history(store).first()
    assert abs(out["unique_channels"] - 20_000) <= 0.05 * 20_000 and out["usage_count"] == 60_000 and out["trending_days"] == 60
    e = daily.rank_error(g, ["tag", "category_title"], daily.tag_history(store), "p90_views", 0.9).first()
    assert e["rank_error"] <= 0.03
