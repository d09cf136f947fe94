"""Aggregations that a single groupBy would plan badly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_apart(rows: DataFrame, keys: Sequence[str], aggs: Sequence[Column], distinct: Mapping[str, str]) -> DataFrame:
    """Groups with ``aggs`` and, for each name in ``distinct``, the number of its column's different values.

    In one aggregation every distinct count multiplies the rows and regroups
    all buffers, those of percentiles included, by the counted value. Here each
    count is an aggregation of its own over two or three columns, and the
    results, one row for each group, are joined.
    """
    groups = rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct()
    return count_apart(groups, rows, keys, distinct)


def quantile_apart(rows: DataFrame, keys: Sequence[str], value: str, share: float, name: str, sums: Mapping[str, Column]) -> DataFrame:
    """Groups with the number of their rows ``_n``, the sum and number (``_sum``, ``_n``) of each of ``sums``, and the exact quantile of an integer column.

    The quantile is the value at ceil(share * number of values), in order. One
    aggregation by group and class of values counts and sums, which tells the
    class that holds the place; a second counts the single values of that class,
    1.6 % of their size wide. So no task holds a group's values, and what is
    shuffled grows with the classes and a small part of the values.
    """
    v = F.col(value)
    # any monotonous classes will do: signed steps of a logarithm
    rows = rows.withColumn("_class", F.signum(v).cast("int") * F.floor(F.log1p(F.abs(v.cast("double"))) * 64).cast("int"))
    parts = rows.groupBy(*keys, "_class").agg(F.count("*").alias("_n"), F.count(value).alias("_values"), *[a for k, c in sums.items() for a in (F.sum(c.cast("double")).alias(f"{k}_sum"), F.count(c).alias(f"{k}_n"))])
    w = Window.partitionBy(*keys)
    upto = w.orderBy("_class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.greatest(F.ceil(F.sum("_values").over(w) * F.lit(str(share)).cast("decimal(12,10)")).cast("bigint"), F.lit(1))
    parts = parts.withColumns({"_place": place - (F.sum("_values").over(upto) - F.col("_values")), "_held": F.col("_values")})
    here = F.col("_place").between(1, F.col("_held"))
    totals = [F.sum(c).alias(c) for c in ("_n", *[f"{k}_{end}" for k in sums for end in ("sum", "n")])]
    groups = parts.groupBy(*keys).agg(*totals, F.max(F.when(here, F.struct("_class", "_place"))).alias("_at"))
    at = groups.filter(F.col("_at").isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_at._class").alias("_c"), F.col("_at._place").alias("_p"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    single = rows.select(*keys, value, "_class").join(at, same & (F.col("_class") == F.col("_c"))).groupBy(*[f"_{k}" for k in keys], value, "_p").agg(F.count("*").alias("_m"))
    below = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = single.withColumn("_m", F.sum("_m").over(below)).filter(F.col("_m") >= F.col("_p")).groupBy(*[f"_{k}" for k in keys]).agg(F.min(value).alias(name))
    return groups.drop("_at").join(found, same, "left").drop(*[f"_{k}" for k in keys])


def mean_of(name: str) -> Column:
    return F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n"))


def count_apart(out: DataFrame, rows: DataFrame, keys: Sequence[str], distinct: Mapping[str, str]) -> DataFrame:
    """``out``, one row for each group of rows, with the number of different values of each column in ``distinct``."""
    for name, column in distinct.items():
        n = rows.select(*keys, column).distinct().groupBy(*keys).agg(F.count(column).alias(name))
        n = n.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        out = out.join(n, same).drop(*[f"_{k}" for k in keys])
    return out
