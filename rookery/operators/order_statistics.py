"""Order statistics per group from a distributed sort, for groups of any size.

Distinct values are counted first. The counts are range-partitioned and sorted by (group, value),
so a large group spreads over partitions; counts by (partition, group) give each partition's
offset in its group, and only the partitions that hold a wanted place are read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.session import materialise


def null_safe(left: str, right: str, columns: list[str]) -> Column:
    """left.c and right.c alike in all columns, nulls being alike."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def beside(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """left with right's further columns, by columns, nulls being alike; one row each without columns."""
    more = [c for c in right.columns if c not in columns]
    return left.alias("l").join(right.alias("r"), null_safe("l", "r", columns), "left").select("l.*", *[f"r.{c}" for c in more])


def values_at(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]], count: str | None = None) -> DataFrame:
    """(*by, n, <place>...): of each group's n sorted values those at the places, 0-based ranks that
    are given as functions of n. count names a column that says how often a row's value stands (rows
    with less than 1 take no part). Null and NaN values take no part; null groups count as groups;
    an empty table gives no rows."""
    times = F.lit(1) if count is None else F.col(count)
    sound = rows.select(*by, F.col(value).alias("value"), times.cast("long").alias("times")).where("times > 0").where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    counted = sound.groupBy(*by, "value").agg(F.sum("times").alias("cnt"))
    ordered = materialise(counted.repartitionByRange(*by, "value").sortWithinPartitions(*by, "value").withColumn("part", F.spark_partition_id()))
    held = ordered.groupBy("part", *by).agg(F.sum("cnt").alias("held"))
    group = [F.col(c) for c in by] or [F.lit(0)]
    offsets = held.select(
        "part", *by, "held", (F.sum("held").over(Window.partitionBy(*group).orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy(*group)).alias("n")
    )
    listed = F.array(*[F.struct(F.lit(name).alias("place"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in places.items()])
    wanted = offsets.select("part", *by, "before", "held", "n", F.explode(listed).alias("w")).select("part", *by, "before", "held", "n", "w.*").where("rank >= before and rank < before + held")
    spots = wanted.select("part", *by, "before").distinct()
    near = ordered.alias("o").join(spots.alias("s"), null_safe("o", "s", ["part", *by])).select("o.*", "s.before")
    running = Window.partitionBy("part", *by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("upto", F.col("before") + F.sum("cnt").over(running)).select("part", *by, "value", "upto", (F.col("upto") - F.col("cnt")).alias("start"))
    hit = placed.alias("o").join(wanted.alias("w"), null_safe("o", "w", ["part", *by]) & F.expr("w.rank >= o.start and w.rank < o.upto"))
    return hit.groupBy(*[f"o.{c}" for c in by], "n").agg(*[F.max(F.when(F.col("place") == name, F.col("value"))).alias(name) for name in places])


def medians(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """(*by, <name>): the exact median, the mean of the two middle values of an even number."""
    middle = values_at(rows, by, value, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)})
    return middle.select(*by, ((F.col("low") + F.col("high")) / 2).alias(name))
