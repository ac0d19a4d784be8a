import random
import re

from rookery.llm import cross_split as cs


def norm(t):
    return re.sub("[^a-z0-9]+", " ", t.lower()).strip() if t else ""


def sets(rows):
    return {k: {n[i : i + 5] for i in range(len(n) - 4)} for k, t, *_ in rows if len(n := norm(t)) >= 20}


def made(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    train, held = [], []
    for i in range(120):
        base = ["Something is off with", *[word() for _ in range(rng.randint(2, 25))]]
        train.append((f"t{i}", " ".join(base)))
        if rng.random() < 0.6:
            copy = base[:]
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(1, len(copy))] = word()
            held.append((f"e{i}", ("Hi, " if rng.random() < 0.3 else "") + ", ".join(copy).upper(), rng.choice(["eval", None]), rng.choice(["a", "b"])))
    train += [("t900", None), ("t901", ""), ("t902", "tiny"), ("t903", train[0][1]), ("t0", train[0][1]), ("t904", "x" * 100_000)]
    held += [("e900", None, "eval", "a"), ("e901", "   ", "eval", "a"), ("e902", "???" * 30, "eval", "a")]
    return train, held


def test_pairs_equal_brute_force(spark):
    train, held = made()
    a = spark.createDataFrame([(*r, 1) for r in train], "key string, text string, source int")
    b = spark.createDataFrame(held, "key string, text string, split string, source string")
    got = cs.cross_split_overlaps(a, b, 0.65).collect()
    t, e = sets(train), sets(held)
    want = {(x, y) for x in t for y in e if len(t[x] & e[y]) >= 0.65 * len(t[x] | e[y])}
    assert want and {(r.train_key, r.eval_key) for r in got} == want and len(got) == len(want)
    assert all(0 < r.covered <= 1 for r in got)
    report = cs.overlap_report(cs.cross_split_overlaps(a, b, 0.65)).collect()
    assert sum(r.pairs for r in report) == len(want)


def test_empty_sides(spark):
    a = spark.createDataFrame([], "key string, text string")
    b = spark.createDataFrame([], "key string, text string, split string, source string")
    assert cs.cross_split_overlaps(a, b).count() == 0


def test_report_scans_every_user_turn(spark, tmp_path):
    from rookery.llm import queries

    one, two = "how many pallets did the Elmstow sorter log", "which unit approved the firmware of the code scanner"
    rows = [
        ("t1", "train", "a", [("user", "an opening turn of its own kind"), ("assistant", "yes"), ("User", one), ("user", two)]),
        ("e1", "eval", "a", [("user", "quite another beginning stands here"), (" USER", one), ("user", two)]),
        ("e2", "test", "b", [("user", "nothing of this was ever asked before")]),
    ]
    spark.createDataFrame(rows, "example_id string, split string, source string, messages array<struct<role: string, content: string>>").write.parquet(f"{tmp_path}/chat_examples.parquet")
    spark.createDataFrame([("q1", two, "qa_dev", "c")], "id string, question string, split string, source string").write.parquet(f"{tmp_path}/qa_set.parquet")
    got = {tuple(r) for r in queries.p4_report(spark, str(tmp_path)).collect()}
    assert got == {("eval", "a", 1, 1, 1), ("qa_dev", "c", 1, 1, 1)}
    assert queries.p4_found(spark, str(tmp_path)).count() == 0


def test_shards_and_parts_lose_nothing(spark, monkeypatch):
    train, held = made(5)
    train += [(f"l{i}", "".join("abcdefghij"[(i * k) % 10] for k in range(1, 60 * i)) + " end of a longer text") for i in range(1, 12)]
    held += [(f"h{i}", t + " and more", "eval", "c") for i, (_, t) in enumerate(train[-11:])]
    a = spark.createDataFrame(train, "key string, text string")
    b = spark.createDataFrame(held, "key string, text string, split string, source string")
    t, e = sets(train), sets(held)
    want = {(x, y) for x in t for y in e if len(t[x] & e[y]) >= 0.65 * len(t[x] | e[y])}
    for chars in (300, 2000, 50_000):
        monkeypatch.setattr(cs, "SHARD_CHARS", chars)
        got = cs.cross_split_overlaps(a, b, 0.65).collect()
        assert {(r.train_key, r.eval_key) for r in got} == want and len(got) == len(want)


def test_shard_bands():
    assert cs.shard_bands([(3, 5), (1, 4), (9, 30)], 10) == [(1, 3, 1), (9, 9, 3)] and cs.shard_bands([], 10) == []


def test_one_key_each(spark):
    from pyspark.sql import functions as F

    keys = cs.one_key_each(spark, 13)
    rows = spark.createDataFrame([(k,) for k in keys], "k int").repartition(13, "k").withColumn("p", F.spark_partition_id())
    assert rows.select("p").distinct().count() == 13
