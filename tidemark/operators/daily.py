"""History that is kept up: mergeable figures of each period, so that new days cost what they hold.

``add`` works out the figures of the periods at hand alone and replaces those
partitions of a stored table. Counts, sums, squares, greatest values and the days
themselves (a bit for each day of a month) add up exactly; quantiles come from KLL
sketches and distinct counts from HyperLogLog sketches, which merge within their
error. The histories are then aggregations over the stored table, whose size is
that of its groups and not of the rows behind them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as x
from tidemark.operators import reports
from tidemark.operators.history import CHANNEL_TIERS
from tidemark.operators.tags import SENTINELS
from tidemark.sources import io

#: Size parameters of the sketches: rank errors of 1.3 % and errors of counts of 1.6 %, by their published bounds.
KLL_K, HLL_LG_K = 200, 12
#: Periods by the name of their unit.
UNITS = {"day": "DD", "month": "MM"}
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Grain:
    """What a stored table has a row for, besides the period, which columns it counts different values of, and whether it keeps the squares that deviations need."""

    keys: tuple[str, ...]
    distinct: Mapping[str, str] = field(default_factory=dict)
    squares: bool = True


CHANNELS = Grain(("channel_title", "category_title", "region"))
TAGS = Grain(("tag", "category_title"), {"channels": "channel_title"}, squares=False)
CATEGORIES = Grain(("category_title",), {"channels": "channel_title", "regions": "region"})


def period(day: str | Column, unit: str) -> Column:
    return F.trunc(day, UNITS[unit]) if unit != "day" else F.col(day) if isinstance(day, str) else day


def partials(rows: DataFrame, grain: Grain, unit: str = "day", day: str = "trending_full_date") -> DataFrame:
    """Figures of each period and group of the grain that merge with those of others."""
    like, comment = x.ratio("likes", "views"), x.ratio("comment_count", "views")
    sketches = [F.hll_sketch_agg(c, F.lit(HLL_LG_K)).alias(name) for name, c in grain.distinct.items()]
    return rows.groupBy(period(day, unit).alias("period"), *grain.keys).agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(f"{c}_sum") for c in ("views", "likes", "comment_count")],
        *[F.count(c).alias(f"{c}_n") for c in ("views", "likes", "comment_count")],
        *([F.sum(F.col("views").cast(WIDE) * F.col("views")).cast(WIDE).alias("views_squares")] if grain.squares else []),
        F.max("views").alias("views_max"),
        F.sum(like).alias("like_rate_sum"), F.count(like).alias("like_rate_n"),
        F.sum(comment).alias("comment_rate_sum"), F.count(comment).alias("comment_rate_n"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.day(day) - 1)).alias("days"),
        F.kll_sketch_agg_bigint("views", F.lit(KLL_K)).alias("views_sketch"),
        *sketches,
    )


def add(part: DataFrame, path: str) -> None:
    """Replace the periods that ``part`` has, and leave the others."""
    io.write(part, path, partition_by=("period",), dynamic=True)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(store: DataFrame, keys: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    """The figures of all periods together, for groups of the grain or coarser ones (whose days are then not told apart)."""
    sums = [c for c in store.columns if c.endswith(("_sum", "_n")) or c in ("n", "views_squares")]
    return store.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max("views_max").alias("views_max"),
        F.sum(F.bit_count("days")).alias("days"),
        F.kll_merge_agg_bigint("views_sketch", F.lit(KLL_K)).alias("views_sketch"),
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in distinct],
    )


def mean(c: str) -> Column:
    return F.col(f"{c}_sum") / F.col(f"{c}_n")


def quantile(share: float) -> Column:
    return F.kll_sketch_get_quantile_bigint("views_sketch", F.lit(share))


def deviation() -> Column:
    """The sample's standard deviation, from exact sums: NULL for a single row."""
    n, total = F.col("views_n"), F.col("views_sum").cast(WIDE)
    spread = F.col("views_squares").cast("decimal(38,6)") - (total * total / n).cast("decimal(38,6)")
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0).cast("decimal(38,6)")).cast("double") / (n - 1)))


def channel_history(store: DataFrame) -> DataFrame:
    """The channel history of all periods, from a store of ``CHANNELS``."""
    m = merged(store, CHANNELS.keys)
    df = m.select(
        *CHANNELS.keys, F.col("n").alias("hist_videos"), mean("views").alias("hist_avg_views"), F.col("views_max").alias("hist_max_views"), mean("likes").alias("hist_avg_likes"), mean("comment_count").alias("hist_avg_comments"),
        deviation().alias("hist_stddev_views"), F.col("days").alias("trending_days"),
        (x.ratio(mean("likes"), mean("views")) * 100).alias("like_rate"), (x.ratio(mean("comment_count"), mean("views")) * 100).alias("comment_rate"),
    )
    return df.withColumn("channel_tier", x.at_least("hist_avg_views", CHANNEL_TIERS, "Small Channel"))


def category_benchmarks(store: DataFrame) -> DataFrame:
    """Average and top-decile views of each category and region, from a store of ``CHANNELS``."""
    m = merged(store, ("category_title", "region"))
    return m.select("category_title", "region", mean("views").alias("category_avg_views"), quantile(0.9).alias("top_10_percent_threshold"), F.col("n").alias("category_videos"), mean("likes").alias("category_avg_likes"))


def channel_intelligence(store: DataFrame) -> DataFrame:
    """Figures of each channel in each category and region, from a store of ``CHANNELS``."""
    m = merged(store, CHANNELS.keys)
    return m.select(
        "category_title", "region", "channel_title", F.col("n").alias("batch_videos"), mean("views").alias("batch_avg_views"), F.col("views_sum").alias("batch_total_views"), F.col("views_max").alias("batch_max_views"),
        quantile(0.75).alias("batch_p75_views"), mean("likes").alias("batch_avg_likes"), mean("comment_count").alias("batch_avg_comments"), mean("like_rate").alias("batch_like_rate"), mean("comment_rate").alias("batch_comment_rate"),
        F.col("days").alias("batch_trending_days"),
    )


def tag_rows(golden: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    rows = golden.select("category_title", "channel_title", "trending_full_date", "views", "likes", "comment_count", F.explode("tags_list").alias("tag"))
    return rows.filter(~F.col("tag").isin(*sentinels))


def tag_history(store: DataFrame, min_count: int = 10) -> DataFrame:
    """Figures of each tag and category, from a store of ``TAGS``."""
    m = merged(store, TAGS.keys, ("channels",)).filter(F.col("n") >= min_count)
    return m.select(
        *TAGS.keys, F.col("n").alias("usage_count"), mean("views").alias("avg_views"), mean("likes").alias("avg_likes"), mean("like_rate").alias("avg_like_rate"), mean("comment_rate").alias("avg_comment_rate"),
        quantile(0.9).alias("p90_views"), F.col("channels").alias("unique_channels"), F.col("days").alias("trending_days"),
    )


def daily_partials(golden: DataFrame, unit: str = "day") -> DataFrame:
    """Figures of the daily report for each period and category, with sketches of regions and channels."""
    daily = reports.daily_views(golden).groupBy(period("trending_full_date", unit).alias("period"), "category_title").agg(
        F.sum("video_count").alias("video_sum"), F.sum("avg_views").alias("avg_views_sum"), F.count("avg_views").alias("avg_views_n"), F.hll_sketch_agg("region", F.lit(HLL_LG_K)).alias("regions")
    )
    channels = golden.filter("assignable").groupBy(period("trending_full_date", unit).alias("_p"), F.col("category_title").alias("_c")).agg(F.hll_sketch_agg("channel_title", F.lit(HLL_LG_K)).alias("channels"))
    return daily.join(channels, F.col("period").eqNullSafe(F.col("_p")) & F.col("category_title").eqNullSafe(F.col("_c"))).drop("_p", "_c")


def category_history(store: DataFrame) -> DataFrame:
    """Views, regions and channels of each category over the daily report, from what ``daily_partials`` stored."""
    sketch = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
    m = store.groupBy("category_title").agg(F.sum("video_sum").alias("hist_videos"), (F.sum("avg_views_sum") / F.sum("avg_views_n")).alias("hist_avg_views"), sketch("regions").alias("hist_regions"), sketch("channels").alias("hist_channels"))
    return m.select("category_title", "hist_videos", "hist_avg_views", "hist_regions", "hist_channels")


def rank_error(rows: DataFrame, keys: Sequence[str], values: DataFrame, value: str, share: float) -> DataFrame:
    """keys and rank_error: how far ``value`` of values(keys, value) is from the share's rank among the rows' views."""
    v = values.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_v"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    ranks = rows.join(v, on).groupBy(*keys).agg(F.avg((F.col("views") < F.col("_v")).cast("int")).alias("below"), F.avg((F.col("views") <= F.col("_v")).cast("int")).alias("upto"))
    return ranks.select(*keys, F.greatest(F.lit(0.0), F.col("below") - share, share - F.col("upto")).alias("rank_error"))
