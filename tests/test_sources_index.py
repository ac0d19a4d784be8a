import os

import pytest
from pyspark.sql import functions as F

from rookery.operators import access, audio, query_side, synth
from rookery.sources import readers
from rookery.sources.index_store import IndexStore
from rookery.streaming.incremental import index_new_files, windowed_latency


def test_text_sources(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B\nbody é", encoding="utf-8")
    (tmp_path / "a.md").write_text("plain", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no")
    assert {(r.file, r.text) for r in readers.markdown_corpus(spark, str(tmp_path)).collect()} == {("b.md", "# B\nbody é"), ("a.md", "plain")}
    (tmp_path / "t.tsv").write_text("# note\n\na.wav\t hello\tworld \nbroken line\n")
    good, bad = readers.tsv_transcripts(spark, str(tmp_path / "t.tsv"))
    assert [tuple(r) for r in good.collect()] == [("a.wav", "hello\tworld")] and [r.line for r in bad.collect()] == ["broken line"]
    out = str(tmp_path / "j")
    readers.write_jsonl(spark.createDataFrame([(1, "é"), (2, None)], "i int, t string"), out)
    assert sorted((r.i, r.t) for r in readers.jsonl(spark, out, "i int, t string").collect()) == [(1, "é"), (2, None)]
    assert "é" in "".join((tmp_path / "j" / f).read_text() for f in os.listdir(out) if f.endswith(".json"))
    (tmp_path / "doc.json").write_text('{\n "a": 1\n}')
    assert readers.json_document(spark, str(tmp_path / "doc.json"), "a int").first().a == 1


def test_parquet_rows_and_listing(spark, tmp_path):
    for name, n in (("s1", 3), ("s2", 2)):
        spark.range(n).select(F.concat(F.lit(name), "id").alias("text"), "id").coalesce(1).write.parquet(str(tmp_path / name))
    rows = readers.parquet_texts(spark, str(tmp_path)).collect()
    assert sorted(r.row for r in rows) == [0, 0, 1, 1, 2]
    assert readers.shard_listing(spark, str(tmp_path)).count() == 2


def test_document_paths(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.md").write_text("ok")
    (tmp_path / "secret").write_text("no")
    assert readers.read_document(str(tmp_path / "in"), "x.md") == "ok"
    for name in ("../secret", "missing.md", "/etc/passwd"):
        with pytest.raises(ValueError):
            readers.read_document(str(tmp_path / "in"), name)
    assert [readers.backoff_seconds(i) for i in (0, 3, 6, 9)] == [1, 8, 60, 60]


def rows(spark, shard, n):
    return spark.range(n).select(F.lit(shard).alias("shard_file"), F.col("id").alias("row"), F.lit(10).alias("text_chars"))


def test_commit_protocol(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    with pytest.raises(ValueError, match="empty"):
        store.open()
    store.commit(rows(spark, "a", 5), "m", 8)
    rows(spark, "b", 7).write.partitionBy("shard_file").mode("append").parquet(f"{store.path}/data")  # a run that died
    assert store.open("m").count() == 5 and [tuple(r) for r in store.uncommitted().collect()] == [("b", 7)]
    store.commit(rows(spark, "b", 4), "m", 8)
    assert store.open("m").count() == 9 and store.uncommitted().count() == 0
    assert tuple(store.totals().first()) == (2, 9, 90)
    with pytest.raises(ValueError, match="already"):
        store.commit(rows(spark, "a", 1), "m", 8)
    with pytest.raises(ValueError, match="built with"):
        store.commit(rows(spark, "c", 1), "other", 8)
    with pytest.raises(ValueError, match="not built"):
        store.open("other")
    listed = spark.createDataFrame([("a",), ("c",), ("d",)], "shard_file string")
    assert [r.shard_file for r in store.todo(listed).collect()] == ["c", "d"] and store.todo(listed, 1).count() == 1
    rows(spark, "a", 2).write.partitionBy("shard_file").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{store.path}/data")
    with pytest.raises(ValueError, match="fewer rows"):
        store.open()


def test_incremental_stream(spark, tmp_path):
    src, store = str(tmp_path / "in"), IndexStore(spark, str(tmp_path / "ix"))
    os.makedirs(src)
    add = lambda name, n: spark.createDataFrame([("word " * 100,)] * n, "text string").coalesce(1).write.parquet(str(tmp_path / name)) or [os.rename(str(tmp_path / name / f), os.path.join(src, name + ".parquet")) for f in os.listdir(str(tmp_path / name)) if f.endswith(".parquet")]
    go = lambda: index_new_files(spark, src, store, str(tmp_path / "cp"), lambda df: df, "m", 8)
    add("one", 3)
    go()
    go()
    assert tuple(store.totals().first())[:2] == (1, 3)
    add("two", 2)
    go()
    assert tuple(store.totals().first())[:2] == (2, 5) and store.open("m").count() == 5


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:00:00", "a", 5.0)], "t string, g string, v double").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.n, r.mean_value) for r in windowed_latency(df, "t", "g", "v").collect()) == [(1, 5.0), (2, 2.0)]


def test_tokens(spark):
    e = [("c", 0.0, 0, "authorize", "ac", ["a", "b"], None, None), ("c", 1.0, 1, "exchange", "ac", None, "at1", "rt1"), ("c", 2.0, 2, "exchange", "ac", None, "x", "y"), ("d", 2.0, 2, "exchange", "ac", None, "x", "y"), ("c", 3.0, 3, "use", "at1", None, None, None),
         ("c", 4.0, 4, "refresh", "rt1", ["a", "z"], "at2", "rt2"), ("c", 5.0, 5, "refresh", "rt1", None, "q", "r"), ("c", 5000.0, 6, "use", "at1", None, None, None), ("c", 5001.0, 7, "refresh", "rt2", None, "at3", "rt3"), ("c", 5002.0, 8, "revoke", "rt3", None, None, None), ("c", 5003.0, 9, "use", "at3", None, None, None),
         ("c", 6000.0, 10, "authorize", "ac9", ["a"], None, None), ("c", 6061.0, 11, "exchange", "ac9", None, "p", "q")]
    df = spark.createDataFrame(e, "client string, ts double, seq long, event string, token string, scopes array<string>, access string, refresh string")
    got = {(r.client, r.seq): r.outcome for r in access.token_replay(df).collect()}
    assert [got["c", i] for i in range(12)] == ["issued", "tokens", "code_replay", "ok", "rotated", "invalid_refresh", "denied", "rotated", "revoked_all", "denied", "issued", "code_expired"]
    assert got["d", 2] == "code_replay"


def test_pkce_and_scopes(spark):
    v = "dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk"
    r = spark.range(1).select(access.pkce_challenge(F.lit(v)).alias("c"), access.pkce_valid(F.lit(v), F.lit(v), F.lit("plain")).alias("p")).first()
    assert r.c == "E9Melhoa2OwvFrEMTJguCHaoeK1t8URWbuGJSstw-cM" and r.p is False
    calls = spark.createDataFrame([("ask", ["docs:read"]), ("search", ["docs:read"]), ("zap", [])], "tool string, scopes array<string>")
    assert {r.tool: (r.allowed, r.missing) for r in access.scope_checks(calls).collect()} == {"ask": (False, "docs:ask"), "search": (True, None), "zap": (False, None)}


def test_synthetic_and_leakage(spark):
    choices = {"component": ["a", "b"], "code": ["TLM-1"], "severity": ["SEV1", "SEV3"], "cell": ["x"], "symptom": ["s"], "action": ["go"]}
    made = synth.incident_examples(spark, 400, 1, choices, ["{component} {code} {id}"], "sys")
    rows = made.select(F.col("messages")[1]["content"].alias("u"), F.from_json(F.col("messages")[2]["content"], "component string, severity string, error_code string, page_oncall boolean, action string").alias("l")).collect()
    assert all((r.l.error_code is None) == ("TLM-1" not in r.u) and r.l.page_oncall == (r.l.severity == "SEV1") for r in rows)
    assert 60 < sum(r.l.error_code is None for r in rows) < 140
    assert synth.distinct_examples(made, F.col("messages")[1]["content"], 3).count() == 3
    t, e = spark.createDataFrame([("a",), ("b",), (None,)], "x string"), spark.createDataFrame([("a",), ("c",), (None,)], "x string")
    assert {r.x: r.leaked for r in synth.leaked(e, t, "x").collect()} == {"a": True, "c": False, None: False}
    assert [r.id for r in synth.fixed_sample(spark.range(50), "id", 5, 1).collect()] == [r.id for r in synth.fixed_sample(spark.range(50).repartition(7), "id", 5, 1).collect()]
    x = spark.range(1).select(synth.completion_labels(F.array(F.lit(5), F.lit(6), F.lit(7)), F.lit(2), F.lit(5), 0).alias("x")).first().x
    assert (x.input_ids, x.labels, x.mask) == ([5, 6, 7, 0, 0], [-100, -100, 7, -100, -100], [1, 1, 1, 0, 0])
    assert synth.oversampled(spark.range(2), spark.range(3), 4).count() == 14
    files = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "n string, s int")
    assert [r.n for r in synth.running_prefix(files, "n", "s", 6).collect()] == ["a", "b"]


def test_query_side(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    q = F.lit("Original?")
    assert one(query_side.multi_query(q, F.lit("1. first one\n2. second one\n3. third"), 2)) == ["Original?", "first one", "second one"]
    assert one(query_side.decompose(q, F.lit("- ab"))) == ["Original?"]
    assert [one(query_side.route(F.lit(r))) for r in ("It is a COMPARISON", "lookup or conceptual", "??")] == ["comparison", "lookup", "conceptual"]
    assert one(query_side.hyde(q, F.lit(" "))) == "Original?"


def test_audio(spark):
    quiet, loud = [0.0] * 8000, [0.5, -0.5] * 4000
    df = spark.createDataFrame([(1, quiet + loud + quiet), (2, quiet), (3, [1.0] * 100), (4, None)], "i int, s array<float>")
    got = {r.i: r for r in audio.trim_silence(df, "s").select("i", F.size("trimmed").alias("n"), audio.quality_flags(F.col("s")).alias("f")).collect()}
    assert 8000 < got[1].n < 8000 + 2 * 1920 + 512 and got[1].f == [] and got[2].f == ["too_quiet", "no_signal"] and got[3].f == ["too_short", "clipped"]
    a = audio.augment(df.where("i < 4"), "s", "i", 5)
    assert [r.augmented for r in a.orderBy("i").collect()] == [r.augmented for r in a.repartition(3).orderBy("i").collect()]
    r = audio.resampled(spark.createDataFrame([([0.0, 1.0] * 4000, 8000), ([0.0] * 10, 8000)], "s array<float>, r int"), "s", "r").collect()
    assert len(r[0].resampled) == 16000 and r[1].resampled is None


def test_index_holds_codes_and_one_calibration(spark, tmp_path):
    from rookery.operators import dense

    store = IndexStore(spark, str(tmp_path / "codes"))
    v = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("id") + 1))).alias("v"))
    for shard, low in (("a", 0), ("b", 20)):
        part = v.where(f"id >= {low} and id < {low + 20}")
        store.commit(dense.encode_codes(part, "id", "v", store.calibrate(part, "v", "id")).withColumn("shard_file", F.lit(shard)), "m", 64)
    assert set(store.open("m").columns) == {"item", "code1", "code8", "shard_file"} and store.open("m", verify=False).count() == 40
    assert store.calibration().first().n == 20 and tuple(store.totals().first()) == (2, 40, 0)


def test_commit_works_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows_once = rows(spark, "a", 30).mapInArrow(count, "shard_file string, row long, text_chars int")
    IndexStore(spark, str(tmp_path / "once")).commit(rows_once, "m", 8)
    assert seen.value == 30


def test_shared_folder_is_required_on_clusters(spark):
    from rookery import session

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Bare:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.shared_dir(Bare)
    kept = session.materialise(spark.range(3))
    path = kept._rookery_path.replace("file:", "").replace("//", "/")
    assert os.path.isdir(path)
    session.drop(kept)
    assert not os.path.exists(path)


def test_json_document_is_written_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, None, 0.5)], "i int, t string, x double")
    path = str(tmp_path / "report.json")
    readers.write_json_document(df, path)
    readers.write_json_document(df, path)
    assert sorted(tuple(r) for r in readers.json_document(spark, path, "i int, t string, x double").collect()) == [(1, "é", None), (2, None, 0.5)]
    assert os.listdir(tmp_path) and not [f for f in os.listdir(tmp_path) if f.endswith(".part")]
    with pytest.raises(ValueError, match="more than"):
        readers.write_json_document(spark.range(5), path, most=4)


def test_image_preparation(spark):
    import numpy as np

    g = spark.createDataFrame([(640, 480), (300, 600)], "w int, h int").select(readers.image_geometry(F.col("w"), F.col("h"), 240).alias("g")).collect()
    assert [tuple(r.g) for r in g] == [(320, 240, 40, 0), (240, 480, 0, 120)]
    flat = np.full((30, 50, 3), 255, np.uint8)
    assert np.allclose(readers.square_pixels(flat, 16, False), 1.0) and readers.square_pixels(flat, 16, False).shape == (16, 16, 3)
    ramp = np.tile(np.arange(40, dtype=np.uint8)[None, :, None], (20, 1, 3))
    assert np.array_equal(readers.square_pixels(ramp, 20, False)[:, ::-1], readers.square_pixels(ramp, 20, True))
    df = spark.createDataFrame([(f"i{k}", "t", bytes([k])) for k in range(12)], "file_name string, text string, content binary")
    made = readers.prepared_images(df, lambda c: np.full((4, 6, 3), c[0], np.uint8), 4, 3).collect()
    assert all(len(r.pixels) == 48 for r in made) and abs(made[5].pixels[0] - (int(made[5].file_name[1:]) / 127.5 - 1)) < 1e-6
    flips = [r.f for r in df.select(readers.flips(F.col("file_name"), 3).alias("f")).collect()]
    assert 0 < sum(flips) < 12


def test_vectors_round_trip_with_their_model(spark, tmp_path):
    from rookery.operators import dense

    store = IndexStore(spark, str(tmp_path / "vectors"))
    records = spark.createDataFrame([("a", 1, "one", [1.0, 0.0]), ("a", 2, "two", [0.0, 1.0])], "shard_file string, id int, body string, vec array<float>")
    store.commit(records, "small", 2)
    back = IndexStore(spark, store.path).open("small")
    assert sorted((r.id, r.body, list(r.vec)) for r in back.collect()) == [(1, "one", [1.0, 0.0]), (2, "two", [0.0, 1.0])]
    q = spark.createDataFrame([(9, [0.9, 0.1])], "q int, v array<double>")
    assert [r.item for r in dense.exact_top_k(back, "id", "vec", q, "q", "v", 10).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError, match="not built"):
        store.open("large")
