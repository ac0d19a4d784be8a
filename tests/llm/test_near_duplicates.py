import random
import re
from itertools import combinations

from rookery.llm import near_duplicates as nd

SCHEMA = "tbl string, key long, text string, n int, cls string"


def brute(rows, t, words, least):
    sets = {}
    for tbl, key, text, *_ in rows:
        w = re.findall("[a-z0-9]+", (text or "").lower())
        if tbl is not None and key is not None and len(w) >= max(least, words):
            sets[tbl, key] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    return {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a, b in combinations(sets, 2) if a[0] == b[0] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    rows, key = [], 0
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = base[:]
            for _ in range(rng.randint(0, 14)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[len(copy) // 3 :] + copy[: len(copy) // 3]
            rows.append((rng.choice(["x", "y"]), key, " ".join(copy).upper() + "!", 0, "z"))
            key += 1
    rows += [("x", 900 + i, "same text " * 20, 0, None) for i in range(5)]
    rows += [("x", 990, None, 0, None), (None, 991, "a b c d e f", 0, None), ("x", 992, "", 0, None), ("x", 0, rows[0][2], 0, None)]
    rows.append(("y", 993, "long " + " ".join(f"q{i}" for i in range(30_000)), 0, None))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    for t, words, least in ((0.5, 3, 25), (0.8, 5, 5), (0.65, 2, 4)):
        got = nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), t, words, least).collect()
        assert {(r.tbl, r.key_a, r.key_b) for r in got} == brute(rows, t, words, least)
        assert len(got) == len({(r.tbl, r.key_a, r.key_b) for r in got})


def test_groups_join_links_and_count_copies(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = a.replace("a39", "zz")
    c = b.replace("a0 ", "yy ")
    rows = [("x", 1, a, 0, ""), ("x", 2, a, 0, ""), ("x", 3, b, 0, ""), ("x", 4, c, 0, ""), ("x", 5, "other " * 9, 0, ""), ("y", 1, a, 0, "")]
    got = {(r.tbl, r.key): r for r in nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), 0.8, 5, 5).collect()}
    assert got["x", 1].group_id == got["x", 2].group_id == got["x", 3].group_id == got["x", 4].group_id != got["x", 5].group_id
    assert got["y", 1].group_id != got["x", 1].group_id
    assert (got["x", 1].copies, got["x", 1].links) == (2, 2) and (got["x", 3].copies, got["x", 3].links) == (1, 3)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicate_pairs(none).count() == 0 and nd.near_duplicate_groups(none).count() == 0


def test_sketch_counts(spark):
    df = spark.createDataFrame([([1, 2, 2],), ([2, 3],), (None,)], "v array<long>")
    got = nd.count_sketch(df, "v", 8)
    assert got[1] == 1 and got[3] == 1 and got[2] == 1 + round(8 * 1.584962500721156) and got[4] == 0


def test_heavy_keys_are_parted(spark, monkeypatch):
    rows = corpus(8)
    monkeypatch.setattr(nd, "CELL_ROWS", 3)
    got = nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), 0.5, 3, 25).collect()
    assert {(r.tbl, r.key_a, r.key_b) for r in got} == brute(rows, 0.5, 3, 25) and len(got) == len({(r.tbl, r.key_a, r.key_b) for r in got})


def test_classes_of_equal_halves_are_told_apart(spark, monkeypatch):
    rows = corpus(4)
    real = nd.xxhash.xxh3_128_digest

    class Short:
        xxh3_64_intdigest, xxh32_intdigest = staticmethod(nd.xxhash.xxh3_64_intdigest), staticmethod(nd.xxhash.xxh32_intdigest)
        xxh3_128_digest = staticmethod(lambda raw, seed: bytes([real(raw, seed=seed)[0] & 7]) + bytes(7) + real(raw, seed=seed)[8:])

    texts = [t for _, _, t, *_ in rows if t and len(t) < 2000]
    h, offsets = nd.shingle_sets(texts, 3, 25)
    monkeypatch.setattr(nd, "xxhash", Short)
    halves = [Short.xxh3_128_digest(h[a:b].tobytes(), 0)[:8] for a, b in zip(offsets, offsets[1:]) if b > a]
    assert len(set(halves)) <= 8 < len(halves)
    sigs = spark.createDataFrame(
        [("x", i, Short.xxh3_128_digest(h[a:b].tobytes(), 0), 0, int(b - a), h[a:b].view("int64").tolist()) for i, (a, b) in enumerate(zip(offsets, offsets[1:])) if b > a],
        "tbl string, key long, cls binary, c64 long, n int, sh array<long>",
    )
    pairs = nd.class_pairs(sigs, 0.5).collect()
    sets = {bytes(r.cls): set(r.sh) for r in sigs.collect()}
    want = {tuple(sorted(p)) for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= 0.5 * len(sets[p[0]] | sets[p[1]])}
    assert {tuple(sorted((bytes(r.cls_a), bytes(r.cls_b)))) for r in pairs} == want and len(pairs) == len(want)


def test_sets_are_shuffled_once(spark):
    rows = [("a", i, " ".join(f"w{(i // 2) * 7 + j}" for j in range(12))) for i in range(8)]
    sigs = nd.signatures(spark.createDataFrame(rows, "tbl string, key long, text string"), 3, 3)
    pairs = nd.class_pairs(sigs, 0.5)
    assert "hashpartitioning(cls#" not in pairs._jdf.queryExecution().executedPlan().toString()
