import random

import numpy as np

from rookery.llm import percentiles as pc

P = [0.0, 0.5, 0.9, 0.99, 1.0]


def test_exact_in_every_group_and_from_pieces(spark):
    rng = random.Random(4)
    rows = [(d % 5 if d % 7 else None, rng.choice([None, "a", "b"]), rng.choice([rng.random(), round(rng.random(), 1), float("nan"), None])) for d in range(3000)]
    rows += [(1, "hot", 7.0)] * 2000 + [(1, "one", 3.5)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "day int, g string, value double, cnt int")
    pieces = pc.daily_pieces(df, "day", ["g"], "value")
    parts = [pieces.where("day = 1"), pieces.where("day <> 1"), pieces.where("day is null")]
    joined = parts[0].union(parts[1]).union(parts[2])
    for source in (pieces, joined):
        got = {(r.g, r.probability): (r.n, r.percentile) for r in pc.percentiles_of_pieces(source, ["g"], P).collect()}
        for g in {r[1] for r in rows}:
            values = np.array([r[2] for r in rows if r[1] == g and r[2] is not None and r[2] == r[2]])
            for p in P:
                n, v = got[g, p]
                assert n == len(values) and abs(v - np.percentile(values, 100 * p)) < 1e-9
    wide = pc.wide(pc.percentiles_of_pieces(pieces, ["g"], [0.5]), ["g"], [0.5]).where("g = 'hot'").first()
    assert wide.n == 2000 and wide.p50 == 7.0


def test_empty_and_unmeasured(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", float("nan"))], "day int, g string, value double")
    assert pc.percentiles_of_pieces(pc.daily_pieces(df, "day", ["g"], "value"), ["g"], P).count() == 0
