"""Cleaning raw listings into the typed relation that all reports read, and data gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exprs as x

# Regions in the order of their numbers, and month names as displayed.
REGIONS = ("CA", "DE", "FR", "GB", "IN", "JP", "KR", "MX", "RU", "US")
MONTHS = ("Januar", "Februar", "Mart", "April", "Maj", "Jun", "Jul", "Avgust", "Septembar", "Oktobar", "Novembar", "Decembar")


@dataclass(frozen=True)
class CleanParams:
    max_title: int = 100
    blank_tags: str = "uncategorized"
    empty_tags: str = "unknown"
    strip_quotes: bool = False
    regions: tuple[str, ...] = REGIONS
    months: tuple[str, ...] = MONTHS
    dedup_keys: tuple[str, ...] = ()


def month_name(number: Column, names: tuple[str, ...] = MONTHS) -> Column:
    return F.get(F.array(*[F.lit(m) for m in names]), number - 1)


def clean_content(videos: DataFrame, categories: DataFrame, params: CleanParams = CleanParams()) -> DataFrame:
    """Typed, filtered rows of all regions at once; categories join by region where they have one."""
    keys = ["category_id", "region"] if "region" in categories.columns else ["category_id"]
    cats = categories.select(*[F.trim(k).alias(f"_{k}") if k == "category_id" else F.col(k).alias(f"_{k}") for k in keys], F.col("title").alias("category_title"), F.col("assignable").cast("boolean"))
    on = [F.trim(F.col(k)) == F.col(f"_{k}") if k == "category_id" else F.col(k) == F.col(f"_{k}") for k in keys]
    # categories are a few dozen rows a region; the planner broadcasts what its size limit allows
    # a cleaned title is null where the raw one is; asked here, titles are cleaned once
    df = videos.filter(F.col("title").isNotNull()).join(cats, on, "left")
    long = lambda c: F.trim(c).try_cast("bigint")
    flag = lambda c: F.trim(c).try_cast("boolean")
    part = lambda i: F.get(F.split("trending_date", r"\."), F.lit(i))
    fixed = F.concat_ws(".", part(1), part(2), part(0))
    df = df.select(
        "video_id", "channel_title", "publish_time", "thumbnail_link", "trending_date", "description", "category_title", "assignable", "region",
        x.clean_title("title", params.max_title).alias("video_title"),
        *[long(c).alias(c) for c in ("views", "likes", "dislikes", "comment_count")],
        F.trim("category_id").try_cast("int").alias("category_id"),
        x.clean_tags("tags", params.blank_tags, params.empty_tags, params.strip_quotes).alias("tags_list"),
        *[flag(c).alias(c) for c in ("comments_disabled", "ratings_disabled", "video_error_or_removed")],
        fixed.alias("trending_date_fixed"), F.try_to_date(fixed, "dd.MM.yy").alias("trending_full_date"), F.try_to_date(F.substring("publish_time", 1, 10), "yyyy-MM-dd").alias("publish_date"),
        F.array_position(F.array(*[F.lit(r) for r in params.regions]), F.col("region")).cast("int").alias("region_id"),
    )
    df = df.withColumns(
        {
            "trending_month": month_name(F.month("trending_full_date"), params.months),
            "trending_month_number": F.month("trending_full_date"),
            "trending_year": F.year("trending_full_date"),
            "publish_month": F.month("publish_date"),
            "publish_year": F.year("publish_date"),
        }
    ).filter(F.col("views") > 0)
    return df.dropDuplicates(list(params.dedup_keys)) if params.dedup_keys else df


def gates_of(df: DataFrame, checks: dict[str, tuple[Column, int]]) -> DataFrame:
    """check_name, value and passed: one scan counts the rows of all conditions, each with as many as asked for at least."""
    counted = df.agg(*[F.count_if(condition).alias(name) for name, (condition, _) in checks.items()])
    row = lambda name, least: F.struct(F.lit(name).alias("check_name"), F.col(name).alias("value"), (F.col(name) >= least).alias("passed"))
    return counted.select(F.inline(F.array(*[row(name, least) for name, (_, least) in checks.items()])))


def gates(checks: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """check_name, value and passed: each relation has as many rows as asked for at least."""
    out = None
    for name, (df, least) in checks.items():
        row = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("check_name"), "value", (F.col("value") >= least).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out
