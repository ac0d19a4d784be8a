import random

from pyspark.sql import functions as F

from rookery.llm import mixing as mx


def made():
    rng = random.Random(1)
    docs = [(i, "big", rng.randint(1, 400)) for i in range(4000)] + [(10_000 + i, "small", rng.randint(1, 400)) for i in range(120)] + [(20_000 + i, "tiny", 50) for i in range(3)]
    docs += [(30_000, None, 10), (30_001, "big", None), (30_002, "other", 10), (30_003, "big", 0)]
    return docs, [("big", 0.5, 1), ("small", 0.3, 10), ("tiny", 0.1, 3), ("absent", 0.1, 4)]


def test_shares_caps_and_report(spark):
    docs, targets = made()
    sizes = spark.createDataFrame([(*d, "x") for d in docs], "key long, source string, size long, copies string")
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    total = 100_000
    rows = mx.systematic_mix(sizes, goals, total).collect()
    cap = {s: m for s, _, m in targets}
    assert all(1 <= r.copies <= cap[r.source] for r in rows) and len({r.key for r in rows}) == len(rows)
    held = {s: sum(r.size * r.copies for r in rows if r.source == s) for s in cap}
    assert abs(held["big"] - 50_000) < 1500 and abs(held["small"] - 30_000) < 1500
    assert held["tiny"] == 3 * 3 * 50 and held["absent"] == 0
    report = {r.source: r for r in mx.mix_report(mx.systematic_mix(sizes, goals, total), sizes, goals, total).collect()}
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert report["tiny"].largest_repeat == 3 and report["tiny"].shortfall > 0 and report["absent"].documents == 0


def test_copies_follow_expectation_whatever_the_partitions(spark):
    docs, targets = made()
    sizes = spark.createDataFrame(docs, "key long, source string, size long")
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    a = sorted(map(tuple, mx.systematic_mix(sizes.repartition(1), goals, 200_000).collect()))
    b = sorted(map(tuple, mx.systematic_mix(sizes.repartition(9), goals, 200_000).collect()))
    assert a == b
    assert mx.systematic_mix(sizes.limit(0), goals).count() == 0


def test_redistribution_keeps_the_size(spark):
    assert mx.shared_out([("a", 0.5, 10.0), ("b", 0.3, 1000.0), ("c", 0.2, 1000.0)], 100) == {"a": 10.0, "b": 54.0, "c": 36.0}
    assert mx.shared_out([("a", 0.5, 10.0), ("b", 0.5, 20.0)], 100) == {"a": 10.0, "b": 20.0} and mx.shared_out([], 5) == {}
    rows = [(i, "big" if i % 10 else "small", 5 + i % 7) for i in range(2000)]
    sizes = spark.createDataFrame(rows, "key int, source string, size int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    total = sum(r[2] for r in rows)
    drawn = {r.source: r.s for r in mx.systematic_mix(sizes, targets, redistribute=True).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("s")).collect()}
    assert drawn["small"] == 2 * sum(r[2] for r in rows if r[1] == "small") and abs(sum(drawn.values()) - total) < 30
