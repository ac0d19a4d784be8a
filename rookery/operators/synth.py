"""Synthetic examples, sampling, duplicates and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.functions.text import fill_template


def draw(seed: int, key: Column, salt: str, n: int) -> Column:
    """A number in 0..n-1 that depends on seed, key and salt only."""
    return F.pmod(F.xxhash64(F.lit(seed), key, F.lit(salt)), F.lit(n)).cast("int")


def pick(seed: int, key: Column, salt: str, choices: list[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), draw(seed, key, salt, len(choices)))


def incident_examples(spark: SparkSession, n: int, seed: int, choices: dict[str, list[str]], templates: list[str], system: str) -> DataFrame:
    """(id, messages): chat examples filled from choices (component, code, severity, cell, symptom, action).

    A quarter of the reports omit the error code, and their label has it null; page_oncall is true
    for SEV1 and SEV2. Rows depend on (seed, id) only, so splits use different seeds.
    """
    base = spark.range(n).withColumn("omit", draw(seed, F.col("id"), "omit", 4) == 0)
    for name, values in choices.items():
        base = base.withColumn(name, pick(seed, F.col("id"), name, values))
    spoken = {k: (F.when(F.col("omit"), F.lit("")).otherwise(F.col(k)) if k == "code" else F.col(k)) for k in choices}
    report = fill_template(pick(seed, F.col("id"), "template", templates), spoken)
    label = F.to_json(
        F.struct(
            F.col("component"), F.col("severity"), F.when(~F.col("omit"), F.col("code")).alias("error_code"), F.col("severity").isin("SEV1", "SEV2").alias("page_oncall"), F.col("action")
        ),
        {"ignoreNullFields": "false"},
    )
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return base.select("id", F.array(turn("system", F.lit(system)), turn("user", report), turn("assistant", label)).alias("messages"))


def distinct_examples(examples: DataFrame, text: Column, n: int) -> DataFrame:
    """The first n examples by id with different texts (over-generate, then call)."""
    firsts = examples.withColumn("__t", text).groupBy("__t").agg(F.min_by(F.struct(*examples.columns), "id").alias("e")).select("e.*")
    return firsts.orderBy("id").limit(n)


def duplicate_statistics(df: DataFrame, text: str) -> DataFrame:
    """One row (total, distinct_texts, duplicates)."""
    counted = df.where(F.col(text).isNotNull()).groupBy(F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("s")).agg(F.count("*").alias("c"))
    return counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("distinct_texts")).withColumn("duplicates", F.col("total") - F.col("distinct_texts"))


def leaked(held_out: DataFrame, train: DataFrame, text: str) -> DataFrame:
    """held_out with leaked: whether its text stands verbatim in train. Texts meet as digests."""
    known = train.select(F.sha2(text, 256).alias("__d")).distinct().withColumn("__in", F.lit(True))
    return held_out.withColumn("__d", F.sha2(text, 256)).join(known, "__d", "left").withColumn("leaked", F.coalesce("__in", F.lit(False))).drop("__d", "__in")


def fixed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement that depend on seed and key only."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def strided_sample(df: DataFrame, row: str, stride: int, most: int) -> DataFrame:
    """Every stride-th row by number, at most `most`: a bounded calibration sample."""
    return df.where(F.pmod(F.col(row), F.lit(max(1, stride))) == 0).orderBy(row).limit(most)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def completion_labels(tokens: Column, prompt_length: Column, length: Column, pad: int, ignore: int = -100) -> Column:
    """struct(input_ids, labels, mask) padded to length; prompt and padding labels are `ignore`."""
    short = F.greatest(length - F.size(tokens), F.lit(0))
    labels = F.transform(tokens, lambda t, i: F.when(i < prompt_length, ignore).otherwise(t))
    return F.struct(
        F.concat(tokens, F.array_repeat(F.lit(pad), short)).alias("input_ids"), F.concat(labels, F.array_repeat(F.lit(ignore), short)).alias("labels"),
        F.concat(F.transform(tokens, lambda t: F.lit(1)), F.array_repeat(F.lit(0), short)).alias("mask"),
    )


def oversampled(first: DataFrame, second: DataFrame, repeat: int, root_first: str = "first", root_second: str = "second") -> DataFrame:
    """The union of both with a root column, the second's rows `repeat` times."""
    again = second.withColumn("root", F.lit(root_second)).withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).drop("__i") if repeat > 0 else second.withColumn("root", F.lit(root_second)).limit(0)
    return first.withColumn("root", F.lit(root_first)).unionByName(again, allowMissingColumns=True)


def running_prefix(files: DataFrame, name: str, size: str, target: int) -> DataFrame:
    """The fewest files in name order whose sizes reach target (a listing, one row per file)."""
    w = Window.partitionBy(F.lit(0)).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("running", F.sum(size).over(w)).where(F.col("running") - F.col(size) < target)
