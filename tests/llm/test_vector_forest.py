import numpy as np

from rookery.llm import vector_forest as vf


def made(seed=0, clusters=120, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = np.vstack([c + rng.normal(scale=rng.uniform(0.02, 0.35), size=(rng.integers(1, 14), dim)) for c in centres])
    return np.clip(np.round(v * 40), -128, 127).astype(int)


def frame(spark, codes, extra=()):
    rows = [(i, c.tolist(), 0) for i, c in enumerate(codes)] + list(extra)
    return spark.createDataFrame(rows, "chunk_id long, i8 array<tinyint>, id int")


def exact(codes, decoder, k, least):
    u = decoder.unit(codes).astype(np.float64)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    out = set()
    for i in range(len(c)):
        for j in np.argsort(-np.round(c[i], 6), kind="stable")[:k]:
            if c[i, j] >= least:
                out.add((i, int(j)))
    return out


def test_recall_against_brute_force(spark):
    codes = made()
    decoder = vf.Decoder([-1.0] * 64, [1.0] * 64)
    entries = vf.packed_codes(frame(spark, codes), "chunk_id", "i8", 64)
    got = {(r.id, r.other) for r in vf.similar_vectors(entries, decoder, 10, 0.9, width=64).collect()}
    want = exact(codes, decoder, 10, 0.9)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    free = {(r.id, r.other) for r in vf.similar_vectors(entries, decoder, 10, width=1024).collect()}
    assert len(free & exact(codes, decoder, 10, -2)) >= 0.9 * 10 * len(codes)


def test_equal_vectors_and_dirty_rows(spark):
    base = made(1, 3)[:4]
    same = [(100 + i, base[0].tolist(), 0) for i in range(15)]
    dirty = [(1, base[1].tolist(), 0), (500, None, 0), (501, [1, 2], 0), (502, [None] * 64, 0), (None, base[2].tolist(), 0)]
    decoder = vf.Decoder([-1.0] * 64, [1.0] * 64)
    entries = vf.packed_codes(frame(spark, base, same + dirty), "chunk_id", "i8", 64)
    assert entries.count() == 4 + 15
    got = vf.similar_vectors(entries, decoder, 10, 0.9, width=64).collect()
    mine = sorted((r.place, r.other) for r in got if r.id == 114)
    assert [o for _, o in mine] == [0, *range(100, 109)]
    assert all(r.id != r.other for r in got) and all(abs(r.cosine) <= 1.00001 for r in got)
    assert vf.similar_vectors(entries.limit(0), decoder, 10, 0.9).count() == 0


def test_search_is_exact(spark):
    rng = np.random.default_rng(5)
    codes = np.clip(np.round((rng.normal(size=(40, 64))[rng.integers(0, 40, 3000)] * 0.6 + rng.normal(size=(3000, 64))) * 30), -128, 127).astype(int)
    decoder = vf.Decoder([-1.0] * 64, [1.0] * 64)
    entries = vf.packed_codes(frame(spark, codes), "chunk_id", "i8", 64)
    got = vf.search(entries, entries.where("id % 50 = 0"), decoder, 10).collect()
    want = {p for p in exact(codes, decoder, 10, -2) if p[0] % 50 == 0}
    assert {(r.id, r.other) for r in got} == want and len(got) == len(want)
    assert vf.search(entries, entries.limit(0), decoder).count() == 0 and vf.search(entries.limit(0), entries, decoder).count() == 0


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(vf, "QUERY_BYTES", 64 * 12 * 5)
    codes = made(4)[:200]
    decoder = vf.Decoder([-1.0] * 64, [1.0] * 64)
    entries = vf.packed_codes(frame(spark, codes), "chunk_id", "i8", 64)
    got = vf.search(entries, entries.where("id < 12"), decoder, 3).collect()
    assert {(r.id, r.other) for r in got} == {p for p in exact(codes, decoder, 3, -2) if p[0] < 12}


def test_shape_keeps_recall():
    for rows in (10**4, 10**6, 10**8):
        length, trees = vf.forest_shape(rows, 1024, 0.9, 0.995)
        together = (1 - np.arccos(0.9) / np.pi) ** length
        assert 1 - (1 - together) ** trees >= 0.995 and rows / 2**length < 2048
    assert vf.forest_shape(100, 1024, 0.9, 0.995) == (0, 1)


def test_hot_leaf_is_cut_or_parted(spark):
    """A third of the rows nearly equal, so that no prefix tells them apart: parts visit each other."""
    rng = np.random.default_rng(9)
    base = rng.integers(-120, 120, size=64)
    hot = np.repeat(base[None], 400, 0)
    hot[np.arange(400), rng.integers(0, 64, 400)] += rng.integers(1, 4, 400)
    codes = np.vstack([hot, rng.integers(-120, 120, size=(800, 64))])
    decoder = vf.Decoder([-1.0] * 64, [1.0] * 64)
    entries = vf.packed_codes(frame(spark, codes), "chunk_id", "i8", 64)
    got = {(r.id, r.other) for r in vf.similar_vectors(entries, decoder, 10, 0.9, width=16).collect()}
    u = decoder.unit(codes, np.float64)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    least = np.sort(cos, axis=1)[:, -10]
    near = sum(cos[a, b] >= least[a] - 1e-7 for a, b in got if a < 400)
    assert len({a for a, _ in got}) >= 400 and near >= 0.99 * 4000


def test_sparse_rows_ascend(spark):
    """Rows whose leaves hold too few others visit the leaves under a shorter prefix."""
    codes = made(7, 60)
    decoder = vf.Decoder([-1.0] * 64, [1.0] * 64)
    forest = vf.Forest(codes.astype(np.int8), len(codes), decoder, 8, 4, 8, 1)
    for tree in forest.trees:
        assert (np.diff(tree.starts) > 0).all() and abs(tree.held.sum() - len(codes)) < 1e-6
    seen = np.zeros(len(codes))
    for tree, rows, cells, guest in forest.places(np.arange(len(codes)), codes.astype(np.int8), vf.projections(64, 4, 1)):
        np.add.at(seen, rows, forest.trees[tree].held[cells >> vf.PART_BITS])
    assert (seen >= forest.enough - 1e-6).all()
