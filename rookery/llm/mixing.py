"""Mixing sources to target shares by systematic sampling.

Every document of a source is expected to come out share * total / available times, at most
max_repeats times. The documents are sorted within their source by size, expected copies are
summed along that order in fixed point (exact, so the sum doesn't depend on partitions), one
random offset is added per source, and a document comes out once per whole number its part of the
sum crosses. Sorting by size spreads the sample evenly over small and large documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.session import materialise

#: Expected copies are counted in units of 1 / FIXED.
FIXED = 1 << 24


def shared_out(rows: list[tuple[str, float, float]], total: float) -> dict[str, float]:
    """Sizes by source of (source, share, most): each its share of total but at most `most`; what capped
    sources leave is shared out among the others by their shares until it is placed or all are full."""
    given, left, free = {}, total, sorted(rows)
    while free:
        weight = sum(share for _, share, _ in free)
        full = [(s, share, most) for s, share, most in free if weight <= 0 or most <= left * share / weight]
        if not full:
            return given | {s: left * share / weight for s, share, _ in free}
        for s, _, most in full:
            given[s] = most
            left -= most
        free = [r for r in free if r[0] not in given]
    return given


def plan_shares(sizes: DataFrame, targets: DataFrame, total: int | None = None, redistribute: bool = False) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, total, expected) by source.

    sizes: (source, size). total: the mix's size; by default that of all documents whose source
    is targeted. expected: copies of each document, share * total / available but at most
    max_repeats. A target without documents has expected 0. redistribute: what sources capped at
    max_repeats leave of the total goes to the others by their shares, so that the mix keeps its
    size; otherwise the mix is smaller and the others keep share * total.
    """
    held = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("available"))
    goals = targets.select("source", "target_share", "max_repeats")
    joined = goals.join(held, "source", "left").na.fill(0, ["documents", "available"])
    budget = F.sum("available").over(Window.partitionBy(F.lit(0))) if total is None else F.lit(int(total))  # one row per target
    if redistribute:
        rows = joined.withColumn("total", budget).collect()  # one row per target
        out = shared_out([(r.source, r.target_share, float(r.max_repeats * r.available)) for r in rows], rows[0].total if rows else 0)
        made = sizes.sparkSession.createDataFrame([(r.source, r.target_share, r.max_repeats, r.documents, r.available, int(r.total), out[r.source] / r.available if r.available else 0.0) for r in rows], joined.schema.simpleString()[7:-1] + ",total:bigint,expected:double")
        return made
    return joined.withColumn("total", budget).withColumn(
        "expected",
        F.when(F.col("available") > 0, F.least(F.col("target_share") * F.col("total") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0),
    )


def systematic_mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, redistribute: bool = False) -> DataFrame:
    """(key, source, size, copies), copies >= 1: the documents drawn and how often.

    sizes: (key, source, size); documents of a null or untargeted source or of size 0 or null are
    never drawn. Equal keys are separate documents. Empty tables give no rows. targets must hold
    a source once.
    """
    known = sizes.select("key", "source", "size").where("source is not null and size > 0")
    plan = plan_shares(known, targets, total, redistribute).select("source", F.round(F.col("expected") * FIXED).cast("long").alias("step")).where("step > 0")
    ordered = materialise(known.join(plan, "source").repartitionByRange("source", "size", "key").withColumn("part", F.spark_partition_id()))
    per_part = ordered.groupBy("source", "part").agg(F.sum("step").alias("held"))
    before = per_part.select("source", "part", (F.sum("held").over(Window.partitionBy("source").orderBy("part")) - F.col("held")).alias("before"))
    along = Window.partitionBy("source", "part").orderBy("size", "key").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("step").over(along) + F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(FIXED))
    return (
        ordered.join(before, ["source", "part"])
        .withColumn("upto", upto)
        .select("key", "source", "size", F.expr(f"cast(upto div {FIXED} - (upto - step) div {FIXED} as int)").alias("copies"))
        .where("copies >= 1")
    )


def mix_report(drawn: DataFrame, sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, drawn_documents, drawn_size,
    largest_repeat, actual_share, shortfall): one row per target.

    actual_share is of all that was drawn; shortfall the part of share * total that repeats
    capped at max_repeats couldn't fill.
    """
    plan = plan_shares(sizes.where("source is not null and size > 0"), targets, total)
    used = drawn.groupBy("source").agg(F.count("*").alias("drawn_documents"), F.sum(F.col("size") * F.col("copies")).alias("drawn_size"), F.max("copies").alias("largest_repeat"))
    joined = plan.join(used, "source", "left").na.fill(0, ["drawn_documents", "drawn_size", "largest_repeat"])
    return joined.withColumn("whole", F.sum("drawn_size").over(Window.partitionBy(F.lit(0)))).select(
        "source", "target_share", "max_repeats", "documents", "available", "drawn_documents", "drawn_size", "largest_repeat",
        F.when(F.col("whole") > 0, F.col("drawn_size") / F.col("whole")).otherwise(0.0).alias("actual_share"),
        F.greatest(F.lit(0.0), F.col("target_share") * F.col("total") - F.col("max_repeats") * F.col("available")).alias("shortfall"),
    )
