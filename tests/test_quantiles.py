import duckdb
from pyspark.sql import functions as F

from tidemark.functions.grouping import quantile_apart
from tidemark.operators import history, tags


def test_quantiles_of_large_groups_are_exact(spark, tmp_path):
    # more rows than percentile_approx keeps: its answer is some place beside the right one
    views = F.pmod(F.xxhash64("id"), F.lit(100_000_000))
    rows = spark.range(200_000).select(
        F.lit("c").alias("category_title"), F.when(F.col("id") % 40 == 0, "s").when(F.col("id") % 3 == 0, "r").alias("region"), F.concat(F.lit("ch"), F.col("id") % 50).alias("channel_title"), F.to_date(F.lit("2020-01-01")).alias("trending_full_date"),
        views.alias("views"), F.lit(5).cast("long").alias("likes"), F.lit(2).cast("long").alias("comment_count"), F.array(F.lit("a"), F.lit("b")).alias("tags_list"),
    )
    rows.write.parquet(str(tmp_path / "g"))
    rows = spark.read.parquet(str(tmp_path / "g"))
    ask = lambda sql: duckdb.connect().execute(sql.replace("FROM g", f"FROM '{tmp_path}/g/*.parquet'")).fetchall()
    want = ask("SELECT region, quantile_disc(views, 0.9), count(*) FROM g GROUP BY 1")
    got = history.category_benchmarks(rows).collect()
    assert sorted((str(r["region"]), r["top_10_percent_threshold"], r["category_videos"]) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    p90, n = ask("SELECT quantile_disc(views, 0.9), count(*) FROM g")[0]
    assert sorted((r["tag"], r["p90_views"], r["usage_count"], r["unique_channels"]) for r in tags.tag_history(rows).collect()) == [("a", p90, n, 50), ("b", p90, n, 50)]
    assert [(r["tag1"], r["tag2"], r["p90_views"]) for r in tags.tag_pair_history(rows).collect()] == [("a", "b", p90)]
    p75 = ask("SELECT quantile_disc(views, 0.75) FROM g")[0][0]
    assert history.channel_intelligence(rows.withColumns({"channel_title": F.lit("one"), "region": F.lit("r")})).first()["batch_p75_views"] == p75


def test_quantiles_of_odd_values(spark):
    data = [("a", v) for v in (-5, -1, 0, 0, 3, None, 2**62)] + [("b", None), (None, 7), (None, 8)]
    got = quantile_apart(spark.createDataFrame(data, "k string, v long"), ["k"], "v", 0.5, "q", {"v": F.col("v")}).collect()
    assert {r["k"]: (r["q"], r["_n"], r["v_n"]) for r in got} == {"a": (0, 7, 6), "b": (None, 1, 0), None: (7, 2, 2)}
