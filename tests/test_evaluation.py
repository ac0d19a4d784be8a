import math
import random

import numpy as np
from pyspark.sql import functions as F

from rookery.operators import evaluation as ev


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([("x", 1, 0, "a"), ("x", 1, 1, "g"), ("x", 2, 0, "g"), ("x", 3, 0, "z"), ("y", 1, 3, "g"), ("y", 1, 4, "g")], "arm string, query int, rank int, source string")
    gold = spark.createDataFrame([(1, ["g", "h"]), (2, ["g"]), (3, ["g"])], "query int, golds array<string>")
    got = {r.arm: r for r in ev.retrieval_metrics(hits, gold, ["arm"], 4).collect()}
    assert (got["x"].n, got["x"].recall_1, got["x"].recall_3) == (3, 1 / 3, 2 / 3) and abs(got["x"].mrr - (0.5 + 1) / 3) < 1e-12
    assert got["y"].recall_3 == 0 and abs(got["y"].mrr - 0.25 / 3) < 1e-12


def test_scored_outputs(spark):
    gold = '{"component": "c", "severity": "SEV1", "error_code": null, "page_oncall": true, "action": "a"}'
    rows = [(0, gold), (1, "```json\n" + gold + "\n```"), (2, gold.replace("true", "1")), (3, gold[:-1]), (4, gold.replace('"action": "a"', '"action": "a", "x": 1')), (5, '{"component": "c"}'), (6, None), (7, "[]")]
    got = ev.scored_outputs(spark.createDataFrame([(i, o, gold) for i, o in rows], "i int, o string, g string"), "o", "g").orderBy("i").collect()
    assert [r.json_valid for r in got] == [True, True, True, False, True, True, False, False]
    assert [r.schema_valid for r in got] == [True, True, True, False, False, False, False, False]
    assert [r.exact for r in got] == [True, True, False, False, False, False, False, False]
    assert not got[2].page_oncall_ok and got[5].component_ok and not got[5].error_code_ok
    s = ev.output_scores(ev.scored_outputs(spark.createDataFrame([(i, o, gold) for i, o in rows], "i int, o string, g string"), "o", "g")).first()
    assert s.n == 8 and s.exact == 0.25 and s.json_valid == 5 / 8


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_edits_against_plain_levenshtein(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choices("abcdef", k=rng.randint(0, 12))), " ".join(rng.choices("abcdef", k=rng.randint(0, 12)))) for _ in range(80)] + [("a b", None), ("", "")]
    got = ev.word_edits(spark.createDataFrame(rows, "r string, h string"), "r", "h").collect()
    assert [g.word_edits for g in got] == [edits((r or "").split(), (h or "").split()) for r, h in rows]


def test_transcript_scores(spark):
    rows = [("The cat, sat!", "the cat sat"), ("one two three", "one too three")]
    r = ev.transcript_scores(spark.createDataFrame(rows, "r string, h string"), "r", "h").first()
    assert (r.n, r.wer, r.sentence_accuracy) == (2, 1 / 6, 0.5) and abs(r.cer - 1 / 24) < 1e-12
    t = ev.term_recall(spark.createDataFrame([("TLM-330 and SEV1", "tlm-330 gone"), ("none", "x")], "r string, h string"), "r", "h", r"TLM-\d+|SEV\d").first()
    assert (t.hits, t.terms, t.recall) == (1, 2, 0.5)


def test_nearest_rank(spark):
    rng = random.Random(2)
    rows = [(g, float(rng.randint(0, 30))) for g in "abc" for _ in range(rng.randint(1, 40))] + [("a", None), ("a", float("nan")), ("d", 4.0)]
    got = {r.g: r for r in ev.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0, 50, 90, 99]).collect()}
    for g in "abcd":
        s = sorted(v for x, v in rows if x == g and v is not None and v == v)
        for p in (0, 50, 90, 99):
            assert got[g][f"p{p}"] == s[min(len(s) - 1, round(p / 100 * (len(s) - 1)))] and got[g].n == len(s)


def test_small_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None)], "g string, v double")
    assert {r.g: (r.runs, r["median"], r.spread_pct) for r in ev.spread(df, ["g"], "v").collect()} == {"a": (2, 2.0, 100.0), "b": (1, 2.0, 0.0)}
    assert {r.g: r.ratio for r in ev.relative_to(spark.createDataFrame([("bf16", 2.0), ("int4", 1.0), ("bad", None)], "g string, v double"), "g", "v", "bf16").collect()} == {"bf16": 1.0, "int4": 0.5}
    assert ev.relative_to(spark.createDataFrame([("z", 2.0), ("y", 4.0)], "g string, v double"), "g", "v", "bf16").where("g = 'z'").first().ratio == 0.5
    r = ev.linear_projection(spark.createDataFrame([(10, 5.0), (20, 8.0)], "n int, ms double"), "n", "ms", 2000, 1.0).first()
    assert r.projected == 801.0 and r.too_slow
    assert abs(ev.perplexity(spark.createDataFrame([(1.0,), (3.0,)], "l double"), "l").first().perplexity - math.exp(2)) < 1e-12
    s = ev.size_statistics(spark.createDataFrame([(x,) for x in (5, 1, 9, 9, None)], "v int"), "v").first()
    assert (s.least, s.upper_median, s.most) == (1, 9, 9)


def test_ragas_and_majority(spark):
    df = spark.createDataFrame([([True, False], 1.0), ([], None)], "v array<boolean>, m double")
    got = df.select(ev.ragas_ratio(F.col("v")).alias("r"), ev.ragas_overall(ev.ragas_ratio(F.col("v")), F.col("m")).alias("o")).collect()
    assert [(g.r, g.o) for g in got] == [(0.5, 0.75), (0.0, 0.0)]
    train = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "z"), ("b", None)], "c string, v string")
    r = ev.majority_baseline(train, spark.createDataFrame([("a", "x"), ("b", "y"), ("q", "x")], "c string, v string"), "c", "v").first()
    assert (r.n, r.global_share, r.conditional_share) == (3, 2 / 3, 2 / 3)
    assert spark.range(1).select(ev.rule_consistent(F.lit("SEV1"), F.lit(True)).alias("a"), ev.rule_consistent(F.lit("SEV3"), F.lit(True)).alias("b")).first() == (True, False)


def test_ann_quality(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    truth, found = f([(1, 10), (1, 11)], "query int, item int"), f([(1, 10), (1, 12)], "query int, item int")
    exact = f([(1, 10, 0.9), (1, 11, 0.7), (1, 12, 0.5)], "query int, item int, score double")
    r = ev.ann_quality(truth, found, exact, 2).first()
    assert r.recall == 0.5 and abs(r.quality - 0.7 / 0.8) < 1e-12 and np.isfinite(r.quality)


def test_order_statistics_against_numpy(spark):
    import numpy as np

    from rookery.operators import order_statistics as os_

    rng = np.random.default_rng(3)
    rows = [(None if g == 2 else f"g{g}", float(x)) for g in range(4) for x in rng.integers(0, 50, [1, 2, 400, 901][g])] + [("g1", None), ("g1", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r.low, r.mid, r.top) for r in os_.values_at(df, ["g"], "v", {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}).collect()}
    median = {r.g: r.median for r in os_.medians(df, ["g"], "v").collect()}
    for g in ("g0", "g1", None, "g3"):
        s = sorted(v for h, v in rows if h == g and v is not None and v == v)
        assert got[g] == (len(s), s[0], s[len(s) // 2], s[-1]) and median[g] == np.median(s)
    assert os_.medians(df, [], "v").first().median == np.median([v for _, v in rows if v is not None and v == v])
    assert os_.medians(df.limit(0), ["g"], "v").count() == 0


def test_word_edits_of_any_vocabulary(spark):
    many = " ".join(f"w{i}" for i in range(400))
    rows = [("a b c", "a x c"), ("", "a b"), (None, None), ("日本 b", "b 日本"), (many, many.replace("w7 ", "")), ("  a  ", "a"), ("a a a", "a")]
    got = [(r.ref_words, r.word_edits) for r in ev.word_edits(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, h string"), "r", "h").orderBy("i").collect()]
    assert got == [(3, 1), (0, 2), (0, 0), (2, 2), (400, 1), (1, 0), (3, 2)]


def test_judged_outputs(spark):
    rows = [('so: {"claims": [{"claim": "x", "supported": true}, {"claim": "y", "supported": false}, {"claim": "z"}]} ok',), ('{"claims": []}',), ("no json",), (None,)]
    df = spark.createDataFrame(rows, "o string").withColumn("i", F.monotonically_increasing_id())
    got = df.select("i", ev.faithfulness(F.col("o")).alias("f"), ev.unsupported_claims(F.col("o")).alias("u")).orderBy("i").collect()
    assert [(round(r.f.share, 6), r.f.n) for r in got] == [(0.333333, 3), (0.0, 0), (0.0, 0), (0.0, 0)] and [r.u for r in got] == [["y", "z"], [], [], []]
    one = spark.createDataFrame([(["a" * 2000, "b"],)], "b array<string>").select(ev.numbered_blocks(F.col("b")).alias("x")).first().x
    assert one == "[1] " + "a" * 900 + "\n\n[2] b"
    q = spark.createDataFrame([("q", [3.0, 0.0]), ("r", [1.0, 0.0])], "query string, v array<double>")
    g = spark.createDataFrame([("q", [1.0, 0.0]), ("q", [0.0, 2.0])], "query string, v array<double>")
    assert {r["query"]: r.relevance for r in ev.answer_relevance(q, g, "query", "v").collect()} == {"q": 0.5, "r": 0.0}


def test_concurrency_sweep(spark):
    rows = [(1, i * 1.0, i + 1.0) for i in range(4)] + [(4, 0.0, 1.5)] * 4 + [(None, 0.0, 1.0), (2, None, 1.0)]
    got = {r.level: r for r in ev.concurrency_sweep(spark.createDataFrame(rows, "level int, s double, e double"), "level", "s", "e").collect()}
    assert (got[1].wall_s, got[1].qps, got[1].speedup) == (4.0, 1.0, 1.0) and abs(got[4].speedup - 4 / 1.5) < 1e-9 and got[4].p50_ms == 1500.0 and set(got) == {1, 4, None}
