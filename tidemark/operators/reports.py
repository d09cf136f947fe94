"""Batch reports on the cleaned relation: pure functions of DataFrames, thresholds as arguments.

Results are unordered relations; ``preview`` sorts. Ranks are grouped by report
keys, so that work spreads over categories, regions or channels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as x


def preview(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows, without a global sort."""
    return df.orderBy(*order).limit(n)


def _assignable(golden: DataFrame) -> DataFrame:
    return golden.filter(F.col("assignable"))


def daily_views(golden: DataFrame, trailing: int = 3, by: str = "rows") -> DataFrame:
    """Daily averages of each category and region, their rank and trailing mean over rows or days."""
    keys = ["category_title", "region", "trending_full_date", "comments_disabled"]
    daily = _assignable(golden).groupBy(*keys).agg(F.count("*").alias("video_count"), F.round(F.avg("views"), 2).alias("avg_views"), F.round(F.avg("comment_count"), 2).alias("avg_comments"))
    series = Window.partitionBy("category_title", "region", "comments_disabled")
    if by == "days":
        series = series.orderBy(F.unix_date("trending_full_date")).rangeBetween(1 - trailing, 0)
    else:
        series = series.orderBy("trending_full_date").rowsBetween(1 - trailing, 0)
    ranked = Window.partitionBy("category_title", "region").orderBy(F.desc("avg_views"))
    return daily.withColumns({"views_rank": F.rank().over(ranked), "moving_avg_views_3d": F.round(F.avg("avg_views").over(series), 2)})


def channel_engagement(golden: DataFrame, top: int | None = 5) -> DataFrame:
    """The channels of most engagement in each category; without ``top`` all channels, not ranked."""
    engagement = F.col("likes") + F.col("comment_count")
    stats = _assignable(golden).groupBy("category_title", "channel_title").agg(
        F.count("*").alias("total_videos"),
        F.sum("likes").alias("total_likes"),
        F.sum("dislikes").alias("total_dislikes"),
        F.sum("comment_count").alias("total_comments"),
        F.sum(engagement).alias("engagement_score"),
        F.round(F.sum(engagement) / F.count("*"), 2).alias("avg_engagement_per_video"),
        F.round(x.ratio(F.sum("likes"), F.sum("dislikes")), 2).alias("like_dislike_ratio"),
    )
    if top is None:
        return stats
    w = Window.partitionBy("category_title").orderBy(F.desc("engagement_score"))
    return stats.withColumn("rank_in_category", F.rank().over(w)).filter(F.col("rank_in_category") <= top)


def fast_and_lasting(golden: DataFrame, share: float = 0.10, as_coded: bool = False) -> DataFrame:
    """Regions among the fastest to trend and the longest trending of their category.

    ``as_coded`` keeps those of the shortest duration, as the numbers of the
    original program have it.
    """
    dated = golden.filter(F.col("publish_date").isNotNull() & F.col("trending_full_date").isNotNull())
    videos = dated.groupBy("category_title", "region", "publish_date", "video_id").agg(
        F.datediff(F.min("trending_full_date"), F.col("publish_date")).alias("days"), F.count_distinct("trending_full_date").alias("lasted")
    )
    means = videos.groupBy(F.col("category_title").alias("category"), "region").agg(F.round(F.avg("days"), 2).alias("avg_days_to_trend"), F.round(F.avg("lasted"), 2).alias("avg_trend_days"))
    w = Window.partitionBy("category")
    ranked = means.withColumns({"_fast": F.percent_rank().over(w.orderBy("avg_days_to_trend")), "_long": F.percent_rank().over(w.orderBy(F.desc("avg_trend_days")))})
    lasting = F.col("_long") >= 1 - share if as_coded else F.col("_long") <= share
    kept = ranked.filter((F.col("_fast") <= share) & lasting)
    return kept.select("category", "region", "avg_days_to_trend", "avg_trend_days", F.round(F.col("_fast") * 100, 2).alias("pct_rank_fastest"), F.round(F.col("_long") * 100, 2).alias("pct_rank_longest"))


def problem_type() -> Column:
    comments, ratings = F.coalesce("comments_disabled", F.lit(False)), F.coalesce("ratings_disabled", F.lit(False))
    return x.bucketize(
        [
            (F.coalesce("video_error_or_removed", F.lit(False)), "Removed"),
            (comments & ratings, "All Interactions Disabled"),
            (comments, "Comments Disabled Only"),
            (ratings, "Ratings Disabled Only"),
        ],
        "No Issue",
    )


def common_problem(golden: DataFrame) -> DataFrame:
    """The commonest problem of each category and region; ties go to the first by name."""
    named = golden.filter(F.col("category_title").isNotNull() & (F.col("category_title") != ""))
    counts = named.withColumn("problem_type", problem_type()).filter("problem_type <> 'No Issue'").groupBy("category_title", "region", "problem_type").agg(F.count("video_id").alias("num_videos"))
    w = Window.partitionBy("category_title", "region")
    shares = counts.withColumn("pct", F.round(F.col("num_videos").cast("double") / F.sum("num_videos").over(w) * 100, 1))
    first = shares.withColumn("_n", F.row_number().over(w.orderBy(F.desc("pct"), "problem_type"))).filter("_n = 1")
    return first.select("category_title", "region", "problem_type", "num_videos", F.concat(F.col("pct").cast("string"), F.lit("%")).alias("pct_of_local"))


def fast_channels(golden: DataFrame, top: int = 20, within_days: int = 30, fast_days: int = 3, min_videos: int = 5, trailing: int = 7) -> DataFrame:
    """Channels whose videos trend soonest. Ties of a date are in order of the video's id and views."""
    w = Window.partitionBy("channel_title").orderBy("trending_full_date", "video_id", "views").rowsBetween(1 - trailing, 0)
    dated = golden.filter(F.col("publish_date").isNotNull() & F.col("trending_full_date").isNotNull()).select("channel_title", "category_title", "video_id", "trending_full_date", "publish_date", "views")
    timed = dated.withColumn("days", F.datediff("trending_full_date", "publish_date")).filter("days >= 0").withColumn("momentum", F.avg("views").over(w))
    stats = timed.filter(F.col("days") <= within_days).groupBy("channel_title", "category_title").agg(
        F.count("*").alias("total_viral_videos"),
        F.round(F.avg("days"), 1).alias("avg_days_to_viral"),
        F.round(F.avg("momentum"), 0).alias("avg_momentum"),
        F.round(F.count_if(F.col("days") <= fast_days) * F.lit(100.0) / F.count("*"), 1).alias("fast_viral_percentage"),
    )
    return preview(stats.filter(F.col("total_viral_videos") >= min_videos), top, F.desc("fast_viral_percentage"), F.desc("avg_momentum"), "channel_title", "category_title")


def description_thumbnail(golden: DataFrame, min_videos: int = 10) -> DataFrame:
    """Performance by description length and thumbnail quality; a ``description_length`` spares moving the texts."""
    length = F.col("description_length") if "description_length" in golden.columns else F.length("description")
    thumb = x.bucketize([(F.col("thumbnail_link").contains("maxresdefault"), "High Quality"), (F.col("thumbnail_link").contains("hqdefault"), "Medium Quality")], "Standard Quality")
    classed = _assignable(golden).select("category_title", "views", "likes", x.length_bucket(length).alias("description_length_category"), thumb.alias("thumbnail_quality"))
    stats = classed.groupBy("category_title", "description_length_category", "thumbnail_quality").agg(
        F.count("*").alias("video_count"), F.round(F.avg("views"), 0).alias("avg_views"), F.round(F.avg("likes"), 0).alias("avg_likes")
    )
    w = Window.partitionBy("category_title")
    return stats.filter(F.col("video_count") >= min_videos).withColumns({"performance_rank": F.rank().over(w.orderBy(F.desc("avg_views"))), "performance_percentile": F.percent_rank().over(w.orderBy("avg_views"))})


def launch_timing(golden: DataFrame, min_videos: int = 15, optimal: float = 1.2) -> DataFrame:
    """Months in which to launch, by category and region. Months run by number; ``trending_month`` is a number or an ordered key."""
    keys = ["category_title", "region"]
    dated = _assignable(golden).filter(F.col("trending_month").isNotNull() & F.col("trending_year").isNotNull())
    months = dated.groupBy(*keys, "trending_month", "trending_year").agg(F.count("*").alias("n"), F.avg("views").alias("avg_views"))
    series = Window.partitionBy(*keys).orderBy("trending_year", "trending_month")
    months = months.withColumns({"before": F.lag("avg_views").over(series), "trend": F.avg("n").over(series.rowsBetween(-2, 1))})
    months = months.withColumn("usual", F.avg("trend").over(Window.partitionBy(*keys)))
    growth = F.when(F.avg("before") > 0, x.pct_change(F.avg("avg_views"), F.avg("before")))
    by = months.groupBy(*keys, "trending_month", "usual").agg(
        F.round(F.avg("trend"), 1).alias("trend_strength"), F.coalesce(growth, F.lit(0.0)).alias("mom_growth_pct"), F.sum("n").alias("videos")
    )
    by = by.filter(F.col("videos") >= min_videos)
    strength, usual = F.col("trend_strength"), F.col("usual")
    return by.select(
        *keys, "trending_month", "trend_strength", "mom_growth_pct",
        x.bucketize([(strength > usual * optimal, "OPTIMAL LAUNCH TIME"), (strength > usual, "GOOD TIME")], "AVOID").alias("launch_recommendation"),
        x.at_least("videos", ((50, "HIGH CONFIDENCE"), (20, "MEDIUM CONFIDENCE"), (10, "LOW CONFIDENCE")), "VERY LOW CONFIDENCE").alias("data_confidence"),
        F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("trend_strength"))).alias("month_rank"),
    )


def mega_hits(golden: DataFrame, min_views: int = 100_000_000) -> DataFrame:
    """Each channel's best video, if it is a hit. One aggregation with map-side combine instead of two windows."""
    best = F.max_by(F.struct("video_title", "category_title", "region", "publish_year"), F.struct("views", "video_title", "region", "category_title")).alias("best")
    by = golden.groupBy("channel_title").agg(best, F.max("views").alias("max_views"), F.round(F.avg("views"), 0).alias("avg_views_per_channel"))
    return by.filter(F.col("max_views") >= min_views).select(
        "channel_title", F.col("best.video_title").alias("top_video"), F.col("best.category_title").alias("top_video_category"), "max_views", F.col("best.region").alias("top_region"), "best.publish_year", "avg_views_per_channel"
    )
