"""Tag reports: the exploded base, viral ranks, power levels, and history of tags and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as x
from tidemark.functions.grouping import count_apart, mean_of, quantile_apart

SENTINELS = ("uncategorized", "no-tags", "unknown")


def tag_base(golden: DataFrame, sentinels: tuple[str, ...] = SENTINELS, min_length: int = 3) -> DataFrame:
    """One row for each video and tag, tags lower-cased and trimmed."""
    rows = golden.select("video_id", "likes", "views", "comment_count", "category_title", "region", F.explode("tags_list").alias("tag"))
    tag = F.lower(F.trim("tag"))
    return rows.withColumn("tag", tag).filter((F.length("tag") >= min_length) & ~F.col("tag").isin(*sentinels))


def tag_metrics(tags: DataFrame, min_count: int = 10, viral_likes: int = 100_000, min_score: float = 100) -> DataFrame:
    """One aggregation that feeds both tag reports."""
    n, viral = F.count("*"), F.count_if(F.col("likes") > viral_likes)
    by = tags.groupBy("tag").agg(
        n.alias("video_count"),
        F.count_distinct("region").alias("regions_count"),
        F.count_distinct("category_title").alias("categories_count"),
        F.round(F.avg("likes"), 0).alias("avg_likes"),
        F.round(F.avg("views"), 0).alias("avg_views"),
        F.round(viral * F.lit(100.0) / n, 2).alias("viral_success_rate"),
        (n * F.lit(0.3) + F.avg("likes") * F.lit(0.0001) + viral * 50).alias("viral_score"),
    )
    return by.filter((F.col("video_count") >= min_count) & (F.col("viral_score") > min_score))


def tag_rank(metrics: DataFrame, top: int = 30) -> DataFrame:
    """The top tags by rounded score; ties by name."""
    cols = metrics.select("tag", "video_count", "avg_likes", "viral_success_rate", "regions_count", "categories_count", F.round("viral_score", 0).alias("viral_score"))
    best = cols.orderBy(F.desc("viral_score"), "tag").limit(top)
    return best.withColumn("overall_rank", F.row_number().over(Window.orderBy(F.desc("viral_score"), "tag")))


def tag_power(metrics: DataFrame, top: int = 30) -> DataFrame:
    """Power levels, ranks inside a level, and market positions of the top tags."""
    rate, n, likes = F.col("viral_success_rate"), F.col("video_count"), F.col("avg_likes")
    rules = ((rate > 50) & (n > 50), (rate > 30) & (likes > 500_000), (n > 100) & (likes > 100_000), rate > 20)
    level = x.bucketize(zip(rules, ("MAGIC", "POWERFUL", "RELIABLE", "PROMISING")), "AVERAGE")
    advice = x.bucketize(zip(rules, ("MUST USE", "HIGHLY RECOMMENDED", "SAFE CHOICE", "EMERGING")), "CONSIDER")
    kind = x.bucketize([(rate > 90, "TOP FREQUENCY"), (likes > 1_000_000, "TOP PERFORMANCE"), (rate > 40, "HIGH SUCCESS")], "GOOD")
    df = metrics.withColumns({"tag_power_level": level, "tip_taga": kind, "recommendation": advice})
    by = Window.partitionBy("tag_power_level")
    score = by.orderBy(F.desc("viral_score"))
    df = df.withColumns(
        {
            "rank_within_power_level": F.rank().over(score),
            "_pct": F.percent_rank().over(by.orderBy("viral_success_rate")),
            "smoothed_viral_score": F.round(F.avg("viral_score").over(by.orderBy(F.desc("viral_score"), "tag").rowsBetween(-2, 2)), 0),
        }
    )
    df = df.select(
        "tag", F.col("regions_count").alias("active_regions"), "categories_count", "tag_power_level", "tip_taga", "recommendation", "viral_success_rate", "avg_likes",
        F.round("viral_score", 0).alias("viral_score"), "rank_within_power_level", F.round(F.col("_pct") * 100, 1).alias("success_percentile"),
        x.at_least("_pct", ((0.90, "TOP 10%"), (0.75, "TOP 25%"), (0.50, "TOP 50%")), "STANDARD").alias("market_position"), "smoothed_viral_score",
    )
    best = df.orderBy(F.desc("viral_score"), "tag").limit(top)
    return best.withColumn("global_rank", F.row_number().over(Window.orderBy(F.desc("viral_score"), "tag")))


def tag_history(golden: DataFrame, sentinels: tuple[str, ...] = SENTINELS, min_count: int = 10) -> DataFrame:
    """Figures of each tag and category."""
    return _figures(_tagged(golden, sentinels), ["tag", "category_title"]).filter(F.col("usage_count") >= min_count)


def tag_averages(golden: DataFrame, sentinels: tuple[str, ...] = SENTINELS, min_count: int = 10) -> DataFrame:
    """The averages of ``tag_history`` alone, which take one aggregation."""
    by = _tagged(golden, sentinels).groupBy("tag", "category_title").agg(F.count("*").alias("usage_count"), *[F.avg(c).alias(name) for name, c in _averages().items()])
    return by.filter(F.col("usage_count") >= min_count)


def _tagged(golden: DataFrame, sentinels: tuple[str, ...]) -> DataFrame:
    return golden.select("category_title", "channel_title", "trending_full_date", "views", "likes", "comment_count", F.explode("tags_list").alias("tag")).filter(~F.col("tag").isin(*sentinels))


def tag_pair_history(golden: DataFrame, sentinels: tuple[str, ...] = SENTINELS, min_count: int = 5) -> DataFrame:
    """Figures of each pair of neighbouring tags and category."""
    rows = golden.select("category_title", "channel_title", "trending_full_date", "views", "likes", "comment_count", F.explode(x.adjacent_pairs("tags_list")).alias("p"))
    rows = rows.withColumns({"tag1": F.col("p.first"), "tag2": F.col("p.second")}).filter(~F.col("tag1").isin(*sentinels) & ~F.col("tag2").isin(*sentinels))
    return _figures(rows, ["tag1", "tag2", "category_title"]).filter(F.col("usage_count") >= min_count)


def _averages() -> dict[str, Column]:
    return {"avg_views": F.col("views"), "avg_likes": F.col("likes"), "avg_like_rate": x.ratio("likes", "views"), "avg_comment_rate": x.ratio("comment_count", "views")}


def _figures(rows: DataFrame, keys: list[str]) -> DataFrame:
    q = quantile_apart(rows, keys, "views", 0.9, "p90_views", _averages())
    out = q.select(*keys, F.col("_n").alias("usage_count"), *[mean_of(name).alias(name) for name in _averages()], "p90_views")
    return count_apart(out, rows, keys, {"unique_channels": "channel_title", "trending_days": "trending_full_date"})
