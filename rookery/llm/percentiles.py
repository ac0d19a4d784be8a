"""Exact percentiles per group from a full distributed sort with per-partition counts.

Daily pieces hold each distinct value of a group and day with its count; pieces of any days or
partitions combine by putting them together. The pieces are range-partitioned and sorted by
(group, value), so a large group spreads over many partitions. Counts by (partition, group) give
each partition's offset in its group; the partitions that hold a wanted position are read again
(order_statistics.values_at) and the neighbouring order statistics interpolated. The error is zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.operators.order_statistics import values_at


def daily_pieces(df: DataFrame, day: str, groups: list[str], value: str) -> DataFrame:
    """(day, *groups, value, cnt). Null and NaN values are left out; a null day is a piece too."""
    return (
        df.select(F.col(day).alias("day"), *groups, F.col(value).cast("double").alias("value"))
        .where("value is not null and not isnan(value)")
        .groupBy("day", *groups, "value")
        .agg(F.count("*").alias("cnt"))
    )


def percentiles_of_pieces(pieces: DataFrame, groups: list[str], probabilities: list[float]) -> DataFrame:
    """(*groups, n, probability, percentile): percentile at position p * (n - 1) of the group's
    sorted values, linearly interpolated.

    pieces: (*groups, value double, cnt long), any number of rows per value; other columns are
    ignored. Null groups count as groups. Pieces with a null or NaN value or cnt <= 0 are left out;
    an empty table gives no rows. No group is gathered in one task.
    """
    at = lambda p: lambda n: F.lit(float(p)) * (n - 1)
    places = {f"low{i}": (lambda f: lambda n: F.floor(f(n)))(at(p)) for i, p in enumerate(probabilities)} | {f"high{i}": (lambda f: lambda n: F.ceil(f(n)))(at(p)) for i, p in enumerate(probabilities)}
    found = values_at(pieces, groups, "value", places, count="cnt")
    between = lambda i, p: F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (at(p)(F.col("n")) - F.floor(at(p)(F.col("n"))))
    listed = F.array(*[F.struct(F.lit(float(p)).alias("probability"), between(i, p).alias("percentile")) for i, p in enumerate(probabilities)])
    return found.select(*groups, "n", F.explode(listed).alias("x")).select(*groups, "n", "x.probability", "x.percentile")


def wide(percentiles: DataFrame, groups: list[str], probabilities: list[float]) -> DataFrame:
    """(*groups, n, p50, ...): one row per group, values to six decimals."""
    return percentiles.groupBy(*groups, "n").agg(*[F.round(F.max(F.when(F.col("probability") == p, F.col("percentile"))), 6).alias(f"p{100 * p:g}".replace(".", "_")) for p in probabilities])
