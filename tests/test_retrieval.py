import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rookery.functions import seams
from rookery.functions import vectors as V
from rookery.operators import dense, fusion, lexical
from rookery.plans.service import Engine

DOCS = [(0, "TLM-330 means the lidar lost lock"), (1, "battery rack charging in the dock"), (2, "the dock door and the lidar"), (3, None), (4, ""), (5, "the the the the the")]


def bm25(docs, question):
    import re

    tok = lambda t: re.findall(r"[a-z0-9]+(?:[-_.][a-z0-9]+)*", (t or "").lower())
    ts = {i: tok(t) for i, t in docs}
    n, avg = len(ts), sum(map(len, ts.values())) / len(ts)
    vocabulary = {w for t in ts.values() for w in t}
    raw = {w: math.log(n - (df := sum(w in t for t in ts.values())) + 0.5) - math.log(df + 0.5) for w in vocabulary}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: (floor if x < 0 else x) for w, x in raw.items()}
    return {i: s for i, t in ts.items() if (s := sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in tok(question))) != 0}


def test_bm25_against_the_formula(spark):
    docs = spark.createDataFrame(DOCS, "doc int, body string")
    q = spark.createDataFrame([(1, "the lidar TLM-330 the"), (2, "zzz")], "query int, question string")
    got = {(r["query"], r.doc): r.score for r in lexical.bm25_scores(docs, "doc", "body", q, "query", "question").collect()}
    want = bm25(DOCS, "the lidar TLM-330 the")
    assert set(got) == {(1, d) for d in want} and all(abs(got[1, d] - s) < 1e-9 for d, s in want.items())
    top = lexical.bm25_top_k(lexical.bm25_scores(docs, "doc", "body", q, "query", "question"), 10).collect()
    assert all(r.score > 0 for r in top) and {r["query"] for r in top} == {1}


def test_bm25_forms_no_row_of_a_shuffle_per_pair(spark):
    docs = spark.createDataFrame(DOCS, "doc int, body string")
    q = spark.createDataFrame([(1, "the lidar TLM-330 the")], "query int, question string")
    plan = lexical.bm25_scores(docs, "doc", "body", q, "query", "question")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "query" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


def test_bm25_searches_shuffle_no_postings(spark):
    docs = spark.createDataFrame(DOCS, "doc int, body string")
    q = spark.createDataFrame([(1, "the lidar TLM-330 the")], "query int, question string")
    plan = lexical.bm25_scores(docs, "doc", "body", q, "query", "question")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_stored_index_is_the_index(spark):
    twice = DOCS + [(0, "the lidar lock"), (1, "TLM-330 is in the dock, the lidar"), (None, "Lock, lock"), (None, "lock dock")]
    for rows in (DOCS, twice):
        docs = spark.createDataFrame(rows, "doc int, body string")
        stored = lexical.stored_index(docs, "doc", "body")
        assert stored.count() == stored.select("doc").distinct().count()
        each = sorted(map(tuple, lexical.unpacked(stored).collect()), key=repr)
        assert each == sorted(map(tuple, lexical.index(docs, "doc", "body").collect()), key=repr)
        want = sorted(map(tuple, lexical.document_frequency(lexical.index(docs, "doc", "body")).collect()))
        assert sorted(map(tuple, lexical._frequencies(stored).collect())) == want


def test_stored_index_holds_no_lists(spark):
    stored = lexical.stored_index(spark.createDataFrame(DOCS, "doc int, body string"), "doc", "body")
    assert dict(stored.dtypes) == {"doc": "int", "terms": "string", "tfs": "binary", "dls": "binary"}


def test_found_tokens_are_those_of_the_pattern():
    import re

    import pyarrow as pa

    from rookery.functions.text import TOKEN_PATTERN, found_tokens

    rng = np.random.default_rng(2)
    texts = [None, "", "a", "-a.b_", "a--b", "a.\nb", "x" * 300, *("".join(rng.choice(list("ab9-_. é漢\n"), n)) for n in rng.integers(0, 30, 300))]
    for array in (pa.array(texts), pa.array(["a-", *texts, "b"]).slice(1, len(texts)), pa.array(texts[:0], pa.string()), pa.array([None, ""], pa.string())):
        rows, words = found_tokens(array)
        assert list(zip(rows.tolist(), words.to_pylist())) == [(i, w) for i, t in enumerate(array.to_pylist()) for w in re.findall(TOKEN_PATTERN, t or "")]


def many_texts(seed=3, n=90, words=40):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, words + 1)
    return [(i, " ".join(f"w{x}" for x in rng.choice(words, rng.integers(0, 25), p=p / p.sum()))) for i in range(n)]


def test_bm25_blocks_agree(spark, monkeypatch):
    docs, asked = many_texts(), many_texts(7, 11, 60)
    df, q = spark.createDataFrame(docs, "doc long, body string").repartition(3), spark.createDataFrame(asked, "query long, question string")
    want = {(i, d): bm25(docs, text).get(d, 0.0) for i, text in asked for d, body in docs if {*text.split()} & {*body.split()}}  # also of weight 0
    for size, rows in ((64 << 20, 1024), (2000, 2)):
        monkeypatch.setattr(lexical, "QUERY_BYTES", size)
        monkeypatch.setattr(lexical, "QUERY_ROWS", rows)
        monkeypatch.setattr(lexical, "POSTINGS", rows * 8)
        got = {(r["query"], r.doc): r.score for r in lexical.bm25_scores(df, "doc", "body", q, "query", "question").collect()}
        assert set(got) == set(want) and all(abs(got[x] - s) < 1e-9 for x, s in want.items())
        best = {(r["query"], r["rank"]): r.doc for r in lexical.bm25_best(df, "doc", "body", q, "query", "question", 5).collect()}
        order = {i: sorted((d for a, d in want if a == i), key=lambda d: (-round(want[i, d], 9), d)) for i, _ in asked}
        assert best == {(i, r): d for i, ds in order.items() for r, d in enumerate(ds[:5])}


def test_bm25_sums_in_any_cut(monkeypatch):
    rng = np.random.default_rng(5)
    doc, term = np.array(sorted((d, t) for d in range(30) for t in rng.choice(20, 6, replace=False))).T
    w, pairs = rng.normal(size=len(doc)), np.array([(x, t) for x in range(7) for t in rng.choice(20, 5, replace=False)])
    qf = rng.integers(1, 3, len(pairs)).astype(float)
    want = np.zeros((7, 30))
    for (x, t), f in zip(pairs, qf):
        np.add.at(want[x], doc[term == t], f * w[term == t])
    for dense_terms, singly in ((256, 1 << 22), (0, 1), (3, 9)):
        monkeypatch.setattr(lexical, "DENSE_TERMS", dense_terms)
        monkeypatch.setattr(lexical, "SINGLY", singly)
        (_, m, asked), *rest = lexical._slices(pairs[:, 0], pairs[:, 1], qf, 7, 20)
        assert not rest and np.allclose(lexical._sums(doc, term, w, 30, asked, m), want)


def test_whole_documents_are_cut_at_their_ends(monkeypatch):
    import pyarrow as pa

    ids = [None] * 3 + ["a"] * 9 + ["b"] + ["c"] * 4 + list("defgh")
    table = pa.table({"doc": ids, "t": pa.array(range(len(ids)), pa.int32()), "w": [float(i) for i in range(len(ids))]})
    for rows, postings, documents in ((4, 5, 2), (1, 1, 1), (100, 1 << 17, 2048)):
        monkeypatch.setattr(lexical, "POSTINGS", postings)
        monkeypatch.setattr(lexical, "DOC_ROWS", documents)
        parts = list(lexical._whole_documents(iter(table.to_batches(max_chunksize=rows))))
        assert all(len(x) <= documents for x, *_ in parts) and [x for d, *_ in parts for x in d.to_pylist()] == [None, *"abcdefgh"]
        assert [(d[int(i)].as_py(), int(t)) for d, at, term, _ in parts for i, t in zip(at, term)] == list(zip(ids, range(len(ids))))
    assert not list(lexical._whole_documents(iter([])))


def clustered(seed=0, n=400, dim=64):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(20, dim))
    v = c[rng.integers(0, 20, n)] + rng.normal(scale=0.15, size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors(spark):
    v = clustered()
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, v array<double>")


def test_exact_top_k_blocks_agree(spark, vectors, monkeypatch):
    v, df = vectors
    q = df.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("qv"))
    want = {(i, int(j), r) for i in range(0, len(v), 40) for r, j in enumerate(np.argsort(-np.round(v @ v[i], 9), kind="stable")[:7])}
    for size in (64 << 20, 6000):
        monkeypatch.setattr(dense, "QUERY_BYTES", size)
        monkeypatch.setattr(dense, "QUERY_ROWS", size // 3000)
        got = dense.exact_top_k(df, "vec_id", "v", q, "query", "qv", 7).collect()
        assert {(r["query"], r.item, r.rank) for r in got} == want
    assert dense.exact_top_k(df.limit(3), "vec_id", "v", q.limit(1), "query", "qv", 50).count() == 3
    assert dense.exact_top_k(df.limit(0), "vec_id", "v", q, "query", "qv", 5).count() == 0


def test_codes(spark, vectors):
    v, df = vectors
    words = [r.w for r in df.orderBy("vec_id").select(V.binary_word(F.col("v")).alias("w")).collect()]
    packed = np.packbits(v > 0, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
    assert words == packed.tolist()
    zero = spark.createDataFrame([([0.0] * 64,), ([-1.0] * 63 + [1.0],)], "v array<double>").select(V.binary_word(F.col("v")).alias("w")).collect()
    assert [r.w for r in zero] == [0, 1]
    cal = dense.calibrate_int8(df, "v", "vec_id")
    row = cal.first()
    lows, highs = np.percentile(v, 0.1, axis=0), np.percentile(v, 99.9, axis=0)
    assert np.allclose(row.lows, lows) and np.allclose(row.spans, highs - lows) and (row.dim, row.n) == (64, 400)
    coded = dense.with_calibration(df, cal).select("vec_id", V.int8_encode(F.col("v"), F.col("lows"), F.col("spans")).alias("c"), "lows", "spans").withColumn("w", V.int8_decode(F.col("c"), F.col("lows"), F.col("spans"))).orderBy("vec_id").collect()
    assert np.array([r.c for r in coded]).tolist() == np.clip(np.round((v - lows) / (highs - lows) * 255) - 128, -128, 127).tolist()
    assert np.abs(np.array([r.w for r in coded]) - v).mean() < ((highs - lows) / 255).mean()


def test_dead_dimension(spark):
    row = dense.calibrate_int8(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0])], "i int, v array<double>"), "v", "i").first()
    assert row.spans[0] == 1.0


def test_cascade_beats_binary(spark, vectors):
    v, df = vectors
    q = df.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("qv"))
    truth = {(i, int(j)) for i in range(0, len(v), 40) for j in np.argsort(-(v @ v[i]), kind="stable")[:10]}
    cal = dense.calibrate_int8(df, "v", "vec_id")
    cas = dense.cascade(dense.encode_codes(df, "vec_id", "v", cal), q, "query", "qv", cal, 100, 10).collect()
    codes = df.select("vec_id", V.binary_word(F.col("v")).alias("c"))
    ham = dense.hamming_top_k(codes, "vec_id", "c", codes.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query"), F.col("c").alias("qc")), "query", "qc", 10).collect()
    hit = lambda rows: len({(r["query"], r.item) for r in rows} & truth) / len(truth)
    assert hit(cas) > 0.85 and hit(cas) > hit(ham) + 0.1
    assert all(r.hamming == 0 for r in ham if r.item == r["query"])


def test_truncate_raises_and_normalises(spark, vectors):
    _, df = vectors
    assert abs(df.select(V.norm(V.truncate(F.col("v"), 8)).alias("n")).first().n - 1) < 1e-12
    with pytest.raises(Exception, match="cannot truncate"):
        df.select(V.truncate(F.col("v"), 65)).collect()


def test_max_sim_and_diversity(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "query int, qt int, v array<double>")
    p = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [0.6, 0.8])], "passage int, pt int, v array<double>")
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "query int, passage int")
    got = {(r["query"], r.passage): r.score for r in dense.max_sim(q, p, pairs).collect()}
    assert got == {(1, 7): pytest.approx(1.8), (1, 8): 0.0, (2, 7): 0.0}
    d = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "g string, v array<double>")
    assert {r.group: round(r.diversity, 9) for r in dense.pairwise_diversity(d, "g", "v").collect()} == {"a": round(2 / 3, 9), "b": 0.0}


def test_rrf(spark):
    arm = lambda items: spark.createDataFrame([(1, x, i) for i, x in enumerate(items)], "query int, item string, rank int")
    got = fusion.reciprocal_rank_fusion(arm(["a", "b", "c"]), arm(["a", "d", "b"]), 10).orderBy("rank").collect()
    assert got[0].item == "a" and got[0].rrf_score == pytest.approx(2 / 60)
    assert [(r.item, r.dense_rank, r.bm25_rank) for r in got[1:]] == [("b", 1, 2), ("d", None, 1), ("c", 2, None)]
    with pytest.raises(ValueError):
        fusion.retrieve("nope", arm(["a"]), arm(["a"]))


@pytest.mark.parametrize("text, n, valid, invalid, grounded", [("[1] and [2]", 2, [1, 2], [], True), ("[3]", 2, [], [3], False), ("no marks", 2, [], [], False), ("NOT_FOUND: x", 0, [], [], True), ("[1][9]", 4, [1], [9], False), (None, 1, [], [], False)])
def test_grounding(spark, text, n, valid, invalid, grounded):
    r = fusion.verified(spark.createDataFrame([(text, n)], "text string, n int"), "text", "n").first()
    assert (r.valid, r.invalid, r.grounded) == (valid, invalid, grounded)


def test_service(spark):
    chunks = spark.createDataFrame([(f"d::{i}", t, "d.md", "d.md") for i, t in enumerate(["tlm-330 means lidar lost lock", "charging dock battery rack", "the conveyor merge is staged"])], "id string, body string, source string, breadcrumb string").withColumn("embedding", seams.embed()(F.col("body")))
    engine = Engine(chunks, generate=lambda df: df.withColumn("text", F.lit("See [1].")))
    q = spark.createDataFrame([(1, "what does TLM-330 mean"), (2, "ab")], "qid int, question string")
    hits = engine.search(q, top_k=99).collect()
    assert {r["query"] for r in hits} == {1} and min(hits, key=lambda r: r.rank).item == "d::0"
    answers = {r["query"]: r for r in engine.ask(q).collect()}
    assert answers[1].grounded and not answers[2].grounded
    assert {r.mode for r in engine.compare(q).collect()} == {"dense", "bm25", "hybrid"}
    with pytest.raises(ValueError):
        engine.search(q, "nope")
    assert engine.health().first().n_chunks == 3


def test_scan_orders_ties_and_leaves_nulls_out(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 3, 7, 5)] + [(1, None), (2, [0.5, 0.5])], "i long, v array<double>").repartition(3)
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "q string, v array<double>")
    got = dense.exact_top_k(items, "i", "v", q, "q", "v", 3).orderBy("rank").collect()
    assert [(r["query"], r.item, r.rank) for r in got] == [("a", 3, 0), ("a", 5, 1), ("a", 7, 2)]
    named = items.select(F.concat(F.lit("n"), "i").alias("i"), "v")
    assert [r.item for r in dense.exact_top_k(named, "i", "v", q, "q", "v", 2).orderBy("rank").collect()] == ["n3", "n5"]
    assert dense.exact_top_k(items, "i", "v", q.limit(0), "q", "v", 3).count() == 0


def test_calibration_of_more_rows_takes_a_sample(spark, vectors, monkeypatch):
    v, df = vectors
    monkeypatch.setattr(dense, "CALIBRATION_ROWS", 150)
    row = dense.calibrate_int8(df, "v", "vec_id").first()
    assert 80 < row.n < 220 and np.abs(np.array(row.lows) - v.min(0)).max() < 1.5


def test_half_precision_keeps_nulls(spark):
    df = spark.createDataFrame([(1, [0.1, 2.0]), (2, None), (3, [])], "i int, v array<float>")
    got = {r.i: r.half for r in dense.to_half(df, "v").collect()}
    assert got[2] is None and got[3] == [] and got[1] == [float(np.float32(np.float16(0.1))), 2.0]


def test_matryoshka_memory_beyond_an_int(spark):
    got = dense.matryoshka_memory(spark, 5_000_000).collect()
    assert [(r.dim, r.float32_gb, r.binary_gb, r.vs_full) for r in got][:2] == [(768, 15.36, 0.48, "1x smaller"), (512, 10.24, 0.32, "2x smaller")]
    assert dense.matryoshka_memory(spark, 20_000_000_000).first().float32_gb == 61440.0


def test_concept_fidelity(spark):
    real = spark.createDataFrame([([2.0, 0.0],), ([0.0, 3.0],)], "r array<double>")
    made = spark.createDataFrame([("p", [1.0, 1.0]), ("p", [5.0, 5.0]), ("q", [1.0, -1.0])], "prompt string, v array<double>")
    assert abs(dense.concept_fidelity(made, "prompt", "v", real, "r").first().value - 0.5) < 1e-12


def _engine(spark):
    chunks = spark.createDataFrame([(f"d::{i}", t, "d.md", "d.md") for i, t in enumerate(["tlm-330 means lidar lost lock", "charging dock battery rack"])], "id string, body string, source string, breadcrumb string").withColumn("embedding", seams.embed()(F.col("body")))
    return Engine(chunks, generate=lambda df: df.withColumn("text", F.when(F.col("n_blocks") > 0, "See [1] and [9].").otherwise("NOT_FOUND")))


def test_ask_stream_events(spark):
    import json

    q = spark.createDataFrame([(1, "what does TLM-330 mean"), (2, "ab")], "qid int, question string")
    rows = _engine(spark).ask_stream(q, top_k=2).orderBy("query", "seq").collect()
    one = [r for r in rows if r["query"] == 1]
    assert [r.seq for r in one] == list(range(len(one))) and [r.event for r in one] == ["sources", *["token"] * 4, "done"]
    assert len(json.loads(one[0].data)) == 2 and "".join(json.loads(r.data)["t"] for r in one[1:-1]) == "See [1] and [9]."
    assert json.loads(one[-1].data) == {"citations": [1, 9], "invalid_citations": [9], "abstained": False, "grounded": False}
    assert [r.data for r in rows if r["query"] == 2][0] == "[]" and json.loads(rows[-1].data)["abstained"]


def test_triage_says_what_is_no_json(spark):
    reports = spark.createDataFrame([(1, "x"), (2, "y")], "qid int, report string")
    model = lambda df: df.withColumn("raw", F.when(F.col("qid") == 1, 'ok {"component": "dock", "page_oncall": true}').otherwise("sorry"))
    got = {r.qid: r for r in _engine(spark).triage(reports, model).collect()}
    assert (got[1].component, got[1].page_oncall, got[1].severity, got[1].error) == ("dock", True, None, None) and got[2].error and got[2].component is None


def test_compare_searches_each_arm_once(spark, monkeypatch):
    seen = []
    for module, name in ((dense, "exact_top_k"), (lexical, "bm25_best")):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, f=f, name=name, **k: (seen.append(name), f(*a, **k))[1])
    q = spark.createDataFrame([(1, "what does TLM-330 mean")], "qid int, question string")
    rows = _engine(spark).compare(q).collect()  # of two chunks a word of one weighs 0, so BM25 has no hit
    assert sorted(seen) == ["bm25_best", "exact_top_k"] and {r["mode"] for r in rows} == {"dense", "hybrid"}


def test_dense_mode_builds_no_lexical_index(spark):
    engine = _engine(spark)
    q = spark.createDataFrame([(1, "what does TLM-330 mean")], "qid int, question string")
    engine.search(q, "dense").collect()
    assert "_postings" not in engine.__dict__
    engine.search(q, "bm25").collect()
    assert "_postings" in engine.__dict__


def test_hash_embed_sums_in_the_order_of_the_text(monkeypatch):
    texts = [t for _, t in many_texts()] + [None, "", "TLM-330 " * 70 + "lock", " ".join(f"x{i}" for i in range(1500))]
    want = np.array([np.sum([np.random.default_rng(xxhash.xxh3_64_intdigest(w)).normal(size=8) for w in (t or "").lower().split()] or [np.zeros(8)], axis=0) for t in texts])
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    for kept, at_a_time in ((200_000, 1 << 16), (3, 5)):
        monkeypatch.setattr(seams, "KEPT", kept)
        monkeypatch.setattr(seams, "AT_A_TIME", at_a_time)
        assert np.array_equal(seams.hash_embed(texts, 8), want / np.where(norms == 0, 1, norms))


def test_overlap_score_over_arrow(spark, monkeypatch):
    from rookery.functions import text as X

    rows = [("The dock, the DOCK door", "door of the rack"), ("dock", None), (None, "dock"), ("", ""), ("a-b a b", "x a-b"), ("-- ?", None), ("TLM-330", "tlm-330."), ("dock", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, b string").coalesce(1)
    scored = df.select("i", seams.overlap_score(F.col("q"), F.col("b")).alias("s"))
    assert "regexp_extract_all" not in scored._jdf.queryExecution().optimizedPlan().toString()
    want = [2 / 3, None, 0.0, 0.0, 1 / 3, 0.0, 1.0, 0.0]
    assert [r.s for r in scored.orderBy("i").collect()] == want
    import pyarrow as pa

    q, b = (pa.array(x) for x in zip(*rows))
    monkeypatch.setattr(X, "TEXT_BYTES", 5)
    lower = pa.compute.utf8_lower
    assert pa.concat_arrays([seams._overlap(lower(q).slice(i, j - i), lower(b).slice(i, j - i)) for i, j in X.stretches(b)]).to_pylist() == want


def test_sweep_reads_the_texts_once(spark, tmp_path, monkeypatch):
    from rookery.plans import catalogue

    spark.createDataFrame([(i, t, f"s{i}", "") for i, t in DOCS], "chunk_key long, body string, source string, breadcrumb string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([("qa-50", "where is the lidar lock", ["s0"]), ("qa-100", "battery rack", ["s1"])], "id string, question string, gold_sources array<string>").write.parquet(str(tmp_path / "qa_set.parquet"))
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in (0, 1, 2, 3, 50, 100)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen, payload = [], catalogue._payload
    monkeypatch.setattr(catalogue, "_payload", lambda *a: (seen.append(1), payload(*a))[1])
    got = {r.arm: (r.n, r.recall_1) for r in catalogue.retriever_sweep_reranked(spark, str(tmp_path)).collect()}
    assert len(seen) == 1 and got == {m: (2, 1.0) for m in ("dense + rerank", "bm25 + rerank", "hybrid + rerank")}
    got = {r.arm: r.n for r in catalogue.retriever_sweep(spark, str(tmp_path)).collect()}
    assert len(seen) == 2 and got == {m: 2 for m in ("dense", "bm25", "hybrid")}


def _question_tables(spark, path):
    """Tables of DOCS with three questions, one of them numbered by a multiple of 50, and one row without a question."""
    rows = [("qa-50", "where is the lidar lock", ["s0"]), ("qa-51", "battery rack", ["s1"]), ("qa-2", "battery rack of the dock", ["none"]), ("qa-3", None, ["s1"])]
    spark.createDataFrame([(i, t, f"s{i}", "") for i, t in DOCS], "chunk_key long, body string, source string, breadcrumb string").write.parquet(f"{path}/chunks.parquet")
    spark.createDataFrame(rows, "id string, question string, gold_sources array<string>").write.parquet(f"{path}/qa_set.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in (0, 1, 2, 3, 50, 51)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_reranked_sweep_asks_every_question(spark, tmp_path):
    import duckdb

    from rookery.plans import catalogue

    d = _question_tables(spark, tmp_path)
    got = {tuple(r) for r in catalogue.retriever_sweep_reranked(spark, d).collect()}
    assert {r[:2] for r in got} == {(m + " + rerank", 3) for m in ("dense", "bm25", "hybrid")}
    con = duckdb.connect()
    for name in ("chunks", "qa_set", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    assert got == set(con.execute(catalogue.ORACLES["retriever_sweep_reranked"]).fetchall())


def test_service_search_asks_every_question(spark, tmp_path):
    from rookery.plans import catalogue

    got = catalogue.service_search(spark, _question_tables(spark, tmp_path)).where("rank = 0").collect()
    assert {r["query"]: r.item for r in got} == {50: 0, 51: 1, 2: 1}


def test_service_ask_asks_every_question(spark, tmp_path):
    from rookery.plans import catalogue

    got = catalogue.service_ask(spark, _question_tables(spark, tmp_path)).collect()
    assert {r["query"]: (r.text, r.n_blocks, r.grounded) for r in got} == {q: ("See [1].", 4, True) for q in (50, 51, 2)}


def test_service_ask_stream_asks_every_question(spark, tmp_path):
    from rookery.plans import catalogue

    got = catalogue.service_ask_stream(spark, _question_tables(spark, tmp_path)).orderBy("query", "seq").collect()
    assert [(r["query"], r.event) for r in got] == [(q, e) for q in (2, 50, 51) for e in ("sources", "token", "token", "done")]


def test_service_compare_asks_every_question(spark, tmp_path):
    from rookery.plans import catalogue

    got = catalogue.service_compare(spark, _question_tables(spark, tmp_path)).where("rank = 0 and mode = 'bm25'").collect()
    assert {r["query"]: r.item for r in got} == {50: 0, 51: 1, 2: 1}


def test_seed_states_are_numpys():
    seeds = [0, 1, 2**32 - 1, 2**32, 2**64 - 1, *np.random.default_rng(1).integers(0, 2**64, 50, dtype=np.uint64).tolist()]
    assert np.array_equal(seams._states(np.array(seeds, np.uint64)), [np.random.SeedSequence(x).generate_state(4, np.uint64) for x in seeds])
    assert seams._states(np.array([], np.uint64)).shape == (0, 4)
    held = seams._Directions(5)
    places = held.places(["a", "lock"])
    assert np.array_equal(held.rows[places], [np.random.default_rng(xxhash.xxh3_64_intdigest(t)).normal(size=5) for t in ("a", "lock")])


def test_dense_search_embeds_no_item_beforehand(spark, monkeypatch):
    """What is needed to cut the questions into blocks is asked of them, not of the items."""
    items = spark.createDataFrame([(0, 1)], "item int, n int").withColumn("v", F.when(F.col("n") == 1, F.raise_error(F.lit("read"))).cast("array<double>"))
    near = dense.exact_top_k(items, "item", "v", spark.createDataFrame([(1, [1.0, 0.0])], "query int, q array<double>"), "query", "q", 2)
    with pytest.raises(Exception, match="read"):
        near.collect()


def test_items_are_made_once_for_all_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "item int, v array<double>")
    asked = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0])], "query int, q array<double>")
    calls, store = [], dense.materialise
    monkeypatch.setattr(dense, "materialise", lambda df: (calls.append(df.columns), store(df))[1])
    monkeypatch.setattr(dense, "QUERY_BYTES", 1)
    got = dense.exact_top_k(items, "item", "v", asked, "query", "q", 1).collect()
    assert calls == [["item", "x"]] and {(r["query"], r.item) for r in got} == {(5, 0), (6, 1)}


def test_reranked_search_ranks_without_bodies(spark, monkeypatch):
    q = spark.createDataFrame([(1, "what does TLM-330 mean")], "qid int, question string")
    ranked, rerank = [], fusion.rerank
    monkeypatch.setattr(fusion, "rerank", lambda hits, *more: (ranked.append(hits.columns), rerank(hits, *more))[1])
    got = _engine(spark).search(q).orderBy("rank").first()
    assert "body" not in ranked[0] and (got.item, got.body) == ("d::0", "tlm-330 means lidar lost lock")


def test_fused_arms_are_stored(spark):
    q = spark.createDataFrame([(1, "what does TLM-330 mean")], "qid int, question string")
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in _engine(spark)._arms(q, "hybrid")]
    assert not any("MapInArrow" in x or "Window" in x for x in plans)


def test_contextual_chunks(spark):
    from rookery.functions import text as X

    df = spark.createDataFrame([("d" * 9000, "chunk", "about"), ("doc", "chunk", " "), ("doc", "chunk", None)], "doc string, chunk string, says string")
    seen = X.contextual_chunks(df, "doc", "chunk", lambda x: x.withColumn("context", F.concat_ws("|", "says", F.length("prompt").cast("string"))))
    assert seen.where("doc like 'dd%'").first().contextual.startswith("about|8") and "prompt" not in seen.columns
    assert [r.contextual for r in X.contextual_chunks(df.where("doc = 'doc'"), "doc", "chunk", lambda x: x.withColumn("context", F.col("says"))).collect()] == ["chunk", "chunk"]


def test_reaching_pairs_are_those_of_the_sums(monkeypatch):
    rng = np.random.default_rng(3)
    for share in (1, 20, 10**6):  # the terms multiplied as a matrix: none to all
        monkeypatch.setattr(lexical, "DENSE_SHARE", share)
        pairs = np.unique(rng.integers(0, (9, 40), (150, 2)), axis=0)
        held = np.unique(rng.integers(0, (60, 40), (700, 2)), axis=0)
        at, term, w = held[:, 0], held[:, 1], rng.choice([1e-9, 0.3, 0.7, 5.0], len(held))
        (_, m, asked), *_ = lexical._slices(pairs[:, 0], pairs[:, 1], rng.integers(1, 4, len(pairs)).astype(float), 9, 40)
        sums = lexical._sums(at, term, w, 60, asked, m)
        need = np.append(np.sort(sums, axis=1)[:-3, -5], [-np.inf, -2.0, 0.0]) - 2e-9
        i, j, s = lexical._reaching(at, term, w, 60, asked, m, need)
        want = np.nonzero((sums > 0) & (sums >= need[:, None]))
        assert np.array_equal(i, want[0]) and np.array_equal(j, want[1]) and np.allclose(s, sums[i, j], rtol=1e-13)


def _met(monkeypatch, module, name, barrier):
    f = getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (barrier.wait(60), f(*a, **k))[1])


def test_sweep_searches_its_arms_at_the_same_time(spark, tmp_path, monkeypatch):
    import threading

    from rookery.plans import catalogue

    spark.createDataFrame([(i, t, f"s{i}", "") for i, t in DOCS], "chunk_key long, body string, source string, breadcrumb string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([("qa-50", "where is the lidar lock", ["s0"]), ("qa-100", "battery rack", ["s1"])], "id string, question string, gold_sources array<string>").write.parquet(str(tmp_path / "qa_set.parquet"))
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in (0, 1, 2, 3, 50, 100)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    both = threading.Barrier(2)
    _met(monkeypatch, catalogue, "_dense_arm", both)
    _met(monkeypatch, catalogue, "_lexical_arm", both)
    got = {r.arm: (r.n, r.recall_1, r.mrr) for r in catalogue.retriever_sweep(spark, str(tmp_path)).collect()}
    assert got["bm25"] == (2, 1.0, 1.0) and got.keys() == {"dense", "bm25", "hybrid"}


def test_works_done_together_raise_what_fails(spark):
    from rookery.session import together

    spark.sparkContext.setLocalProperty("spark.job.description", "both")
    assert together(spark, lambda: spark.range(3).count(), lambda: spark.sparkContext.getLocalProperty("spark.job.description")) == [3, "both"]
    spark.sparkContext.setLocalProperty("spark.job.description", None)
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: spark.range(3).count(), lambda: 1 // 0)


def test_ask_stream_searches_its_arms_at_the_same_time(spark, monkeypatch):
    import threading

    both = threading.Barrier(2)
    _met(monkeypatch, dense, "exact_top_k", both)
    _met(monkeypatch, lexical, "bm25_best", both)
    q = spark.createDataFrame([(1, "what does TLM-330 mean")], "qid int, question string")
    assert [r.event for r in _engine(spark).ask_stream(q).orderBy("seq").collect()] == ["sources", *["token"] * 4, "done"]


def test_fusion_shuffles_once(spark):
    arms = [spark.createDataFrame([(1, i, r) for r, i in enumerate(items)], "query int, item int, rank int") for items in ((5, 6, 7), (6, 8))]
    fused = fusion.reciprocal_rank_fusion(*arms, 10)
    assert fused._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.item, r["rank"]) for r in fused.orderBy("rank").collect()] == [(6, 0), (5, 1), (8, 2), (7, 3)]
