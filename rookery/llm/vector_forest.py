"""Most similar vectors by a hash-prefix forest.

Each tree hashes a vector to a string of 63 sign bits of random orthogonal projections and is the
sorted array of these strings. A leaf is a range of strings under one prefix of variable length:
prefixes grow to the length at which neighbours of the wanted cosine are met with the wanted
probability over all trees, further where many strings share them, less far where few do. The
leaves are fitted on a bounded sample (SAMPLE_ROWS); every row is then indexed. A row descends in
every tree to the leaf of its longest prefix and is compared with all rows there. If the leaves of
all trees hold too few rows, it ascends: in all trees at once its prefix loses a bit, until the
leaves under it hold enough, and it visits those as a guest.

The number of trees follows from the number of rows, so recall doesn't fall as a table grows: with
a leaf of `width` rows it is ln(1 - recall) / ln(1 - p^length), p = 1 - angle / pi being the
probability that a bit agrees and length = log2(rows / width). Equal vectors are one entry; their
ids are put back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.session import materialise

HASH_BITS = 63
#: A cell is named by tree, leaf and part in one number; so many bits for the part.
PART_BITS = 20
#: Rows on which the leaves are fitted; they come to the driver.
SAMPLE_ROWS = 65_536
#: Trees at most, and the cosine they are planned for where none is asked for.
MAX_TREES = 96
PLAN_COSINE = 0.8
#: A leaf may hold so many times `width` rows before it is cut beyond the planned length.
HEAVY = 8
#: Rows a task holds before it hands them on, sorted by leaf.
HELD_ROWS = 1 << 17


def projections(dim: int, trees: int, seed: int) -> np.ndarray:
    """[trees, dim, HASH_BITS]: columns orthonormal within blocks of dim."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        blocks = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-HASH_BITS // dim))]
        out.append(np.hstack(blocks)[:, :HASH_BITS])
    return np.stack(out).astype(np.float32)


class Decoder:
    """int8 codes to unit vectors: (c + 128) / 255 * (max - min) + min per dimension."""

    def __init__(self, lows: list[float], highs: list[float]):
        self.lows, self.spans = np.array(lows, np.float64), np.array(highs, np.float64) - np.array(lows, np.float64)

    def unit(self, codes: np.ndarray, kind: type = np.float32) -> np.ndarray:
        v = codes.astype(kind)
        if kind is np.float64:
            v = (v + 128) / 255 * self.spans + self.lows
        else:
            v *= (self.spans / 255).astype(kind)
            v += (128 / 255 * self.spans + self.lows).astype(kind)
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        v /= np.where(norm == 0, 1, norm)
        return v


def read_decoder(calibration: DataFrame) -> Decoder:
    """One row per dimension, so the driver may hold it."""
    rows = sorted(calibration.select("dim_idx", "min_value", "max_value").collect())
    return Decoder([r.min_value for r in rows], [r.max_value for r in rows])


def packed_codes(df: DataFrame, key: str, codes: str, dim: int) -> DataFrame:
    """(id, vec binary) of rows with dim non-null codes, one row per id (the least vec of a
    repeated id); others take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[i : i + dim] for i in range(0, len(raw), dim)], pa.binary())], names=["id", "vec"])

    whole = df.select(F.col(key).cast("long").alias("id"), F.col(codes).alias("c")).where(f"id is not null and size(c) = {dim} and not exists(c, x -> x is null)")
    return whole.mapInArrow(run, "id long, vec binary").groupBy("id").agg(F.min("vec").alias("vec"))


def forest_shape(rows: int, width: int, cosine: float, recall: float) -> tuple[int, int]:
    """(length, trees): the prefix length at which a leaf holds about `width` rows, and the trees in
    one of which at least a neighbour of that cosine shares it with probability `recall`."""
    length = round(np.log2(rows / width)) if rows > 2 * width else 0
    together = (1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi) ** length
    return length, 1 if together >= recall else int(min(MAX_TREES, np.ceil(np.log(1 - recall) / np.log(1 - together))))


def strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[trees, rows]: the strings of unit vectors as integers."""
    signs = np.zeros((len(unit), 64), bool)
    out = np.empty((len(planes), len(unit)), np.int64)
    for tree, plane in enumerate(planes):
        np.greater(unit @ plane, 0, out=signs[:, 1:])
        out[tree] = np.packbits(signs, axis=1).view(">i8")[:, 0]
    return out


class Tree:
    """The leaves of one tree: where each begins, about how many rows it holds, and in how many parts."""

    def __init__(self, sample: np.ndarray, scale: float, length: int, width: int):
        sample = np.sort(sample)
        starts, held = [], []
        open_ranges = [(0, 0, 0, len(sample))]
        while open_ranges:
            prefix, bits, lo, hi = open_ranges.pop()
            rows = (hi - lo) * scale
            if bits == HASH_BITS or hi - lo < 2 or rows <= width or (bits >= length and rows <= HEAVY * width):
                starts.append(prefix), held.append(rows)
                continue
            half = prefix + (1 << (HASH_BITS - 1 - bits))
            cut = lo + int(np.searchsorted(sample[lo:hi], half))
            open_ranges += [(half, bits + 1, cut, hi), (prefix, bits + 1, lo, cut)]
        self.starts, self.held = np.array(starts, np.int64), np.array(held)
        self.before = np.concatenate(([0.0], np.cumsum(held)))
        self.parts = np.maximum(1, np.ceil(self.held / (HEAVY * width))).astype(np.int64)  # over 1 only if a leaf can't be cut

    def leaf(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, hashes, "right") - 1

    def leaves_under(self, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """First leaf and the one after the last that reach under each string's first `bits` bits."""
        low = (hashes >> (HASH_BITS - bits)) << (HASH_BITS - bits)
        return self.leaf(low), np.searchsorted(self.starts, low + ((1 << (HASH_BITS - bits)) - 1), "right")


class Forest:
    """Trees fitted on a sample of codes."""

    def __init__(self, codes: np.ndarray, rows: int, decoder: Decoder, length: int, trees: int, width: int, seed: int):
        self.decoder, self.seed, self.count, self.enough = decoder, seed, trees, min(trees * width / 2, rows)
        hashes = strings(decoder.unit(codes), projections(codes.shape[1], trees, seed))
        self.trees = [Tree(h, rows / max(1, len(codes)), length, width) for h in hashes]

    def places(self, ids: np.ndarray, codes: np.ndarray, planes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(tree, rows, cells, guest): where rows live, and where they are guests."""
        hashes = strings(self.decoder.unit(codes), planes)
        homes = np.stack([tree.leaf(h) for tree, h in zip(self.trees, hashes)])
        everyone = np.arange(len(ids))
        for t, tree in enumerate(self.trees):
            parts = tree.parts[homes[t]]
            own = (ids * 0x9E3779B1 >> 8) % parts
            yield t, everyone, (homes[t] << PART_BITS) + own, False
            for other in range(1, int(parts.max(initial=1))):
                rows = np.flatnonzero(parts > other)
                yield t, rows, (homes[t][rows] << PART_BITS) + (own[rows] + other) % parts[rows], True
        met = sum(tree.held[homes[t]] for t, tree in enumerate(self.trees))
        few = np.flatnonzero(met < self.enough)
        for bits in range(HASH_BITS - 1, -1, -1):  # ascend in all trees at once
            if not len(few):
                return
            ranges = [tree.leaves_under(hashes[t][few], bits) for t, tree in enumerate(self.trees)]
            done = sum(tree.before[b] - tree.before[a] for tree, (a, b) in zip(self.trees, ranges)) >= self.enough
            if not done.any() and bits:
                continue
            for t, (a, b) in enumerate(ranges):
                a, n, who = a[done], (b - a)[done], few[done]
                rows, leaves = np.repeat(who, n), np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                away = leaves != homes[t][rows]
                rows, leaves = rows[away], leaves[away]
                for part in range(int(self.trees[t].parts[leaves].max(initial=1))):
                    has = self.trees[t].parts[leaves] > part
                    yield t, rows[has], (leaves[has] << PART_BITS) + part, True
            few = few[~done]


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of values from bound to bound as binary."""
    flat = np.ascontiguousarray(values)
    size = flat.nbytes // max(1, len(flat))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


_CELLS = "cell long, guest boolean, ids binary, vecs binary"


def _dealt(entries: DataFrame, forest, dim: int) -> DataFrame:
    """Rows of one leaf that a task holds as one row: (cell, guest, ids, vecs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        planes = projections(dim, f.count, f.seed)
        held: list[pa.RecordBatch] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            ids = table.column(0).to_numpy()
            codes = np.frombuffer(b"".join(table.column(1).to_pylist()), np.int8).reshape(-1, dim)
            for tree, rows, cells, guest in f.places(ids, codes, planes):
                if not len(rows):
                    continue
                order = np.argsort(cells, kind="stable")
                rows, cells = rows[order], cells[order]
                first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
                bounds = np.append(first, len(cells))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[first] + (np.int64(tree) << 44)), pa.array(np.full(len(first), guest)), _packed(ids[rows], bounds), _packed(codes[rows], bounds)], names=["cell", "guest", "ids", "vecs"]
                )

        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= HELD_ROWS:
                yield from hand_on()
                held.clear()
        if held:
            yield from hand_on()

    return entries.select("id", "vec").mapInArrow(run, _CELLS)


def _best(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every row, ties by the lesser column."""
    order = np.lexsort((columns, -np.round(scores, 9), rows))
    r = rows[order]
    first = np.concatenate(([True], r[1:] != r[:-1]))
    place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    return order[place < k]


class Cell:
    """The rows of one leaf: finds for each its best k others with cosine of at least `least`."""

    BLOCK = 1024

    def __init__(self, decoder: Decoder, dim: int, k: int, least: float):
        self.decoder, self.dim, self.k, self.least = decoder, dim, k, least

    def matches(self, home: list[tuple[bytes, bytes]], guests: list[tuple[bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, codes = self._read(home)
        gids, gcodes = self._read(guests)
        unit = self.decoder.unit(codes)
        pairs = self._symmetric(ids, unit)
        yield from self._each(ids, codes, ids, codes, unit, unit) if pairs is None else self._exact(pairs, ids, codes)
        if len(gids):
            yield from self._each(gids, gcodes, ids, codes, self.decoder.unit(gcodes), unit)

    def _read(self, packs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(b"".join(i for i, _ in packs), np.int64)
        return ids, np.frombuffer(b"".join(v for _, v in packs), np.int8).reshape(-1, self.dim)

    def _symmetric(self, ids: np.ndarray, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Every pair once; None if they are so many that rows must choose their best."""
        out = []
        for at in range(0, len(ids), self.BLOCK):
            hit = unit[at : at + self.BLOCK] @ unit[at:].T >= self.least - 1e-4
            places = np.flatnonzero(hit)
            if len(places) > 8 * (self.k + 1) * len(hit):
                return None
            i, j = np.divmod(places, hit.shape[1])
            later = j > i
            out.append((i[later] + at, j[later] + at))
        return out

    def _exact(self, pairs: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j in pairs:
            c = np.einsum("ij,ij->i", self.decoder.unit(codes[i], np.float64), self.decoder.unit(codes[j], np.float64))
            i, j, c = i[c >= self.least], j[c >= self.least], c[c >= self.least]
            if len(i):
                a, b, c = np.concatenate((ids[i], ids[j])), np.concatenate((ids[j], ids[i])), np.concatenate((c, c))
                best = _best(a, b, c, self.k)
                yield a[best], b[best], c[best]

    def _each(self, a_ids, a_codes, b_ids, b_codes, a_unit, b_unit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The best k of b for each of a; a pair of equal ids is none."""
        for at in range(0, len(a_ids), self.BLOCK):
            cos = a_unit[at : at + self.BLOCK] @ b_unit.T
            keep = min(self.k + 1, cos.shape[1])
            if not keep:
                return
            least = np.maximum(np.partition(cos, cos.shape[1] - keep, axis=1)[:, cos.shape[1] - keep], self.least)
            i, j = np.nonzero(cos >= least[:, None] - 1e-4)
            c = np.einsum("ij,ij->i", self.decoder.unit(a_codes[at + i], np.float64), self.decoder.unit(b_codes[j], np.float64))
            a, b = a_ids[at + i], b_ids[j]
            sound = (c >= self.least) & (a != b)
            a, b, c = a[sound], b[sound], c[sound]
            best = _best(a, b, c, self.k)
            yield a[best], b[best], c[best]


def _met(dealt: DataFrame, decoder: Decoder, dim: int, k: int, least: float) -> DataFrame:
    """(a, b, cosine): the best k of every row in each of its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell(decoder, dim, k, least)
        at, packs = None, ([], [])

        def found() -> Iterator[pa.RecordBatch]:
            for a, b, c in cell.matches(*packs):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["a", "b", "cosine"])

        for batch in batches:
            for key, guest, ids, vecs in zip(*(column.to_pylist() for column in batch.columns)):
                if key != at:
                    yield from found()
                    at, packs = key, ([], [])
                packs[guest].append((ids, vecs))
        yield from found()

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, cosine double")


def similar_vectors(entries: DataFrame, decoder: Decoder, k: int = 10, min_cosine: float = -1.0, width: int = 1024, recall: float = 0.995, trees: int | None = None, seed: int = 1) -> DataFrame:
    """(id, other, cosine, place): the k most similar other ids of every id whose cosine is at
    least min_cosine, best first; ties by the lesser id.

    entries: (id, vec) as packed_codes gives. Ids with equal vectors are each other's neighbours
    with cosine 1. A neighbour at min_cosine (PLAN_COSINE without one) is met with probability
    `recall`, closer ones with more; cosines are exact. An empty table gives no rows.
    """
    dim = len(decoder.lows)
    entries = materialise(entries.select("id", "vec"))
    by_vec = Window.partitionBy("vec").orderBy("id")
    firsts = materialise(entries.withColumn("at", F.row_number().over(by_vec)).where(f"at <= {k + 1}"))
    reps = firsts.where("at = 1").select("id", "vec")
    n = reps.count()
    length, planned = forest_shape(n, width, min_cosine if min_cosine > 0 else PLAN_COSINE, recall)
    sample = reps if n <= SAMPLE_ROWS else reps.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 24)) < int((1 << 24) * SAMPLE_ROWS / n))
    codes = np.frombuffer(b"".join(bytes(r.vec) for r in sample.select("vec").collect()), np.int8).reshape(-1, dim)  # about SAMPLE_ROWS
    forest = entries.sparkSession.sparkContext.broadcast(Forest(codes, n, decoder, length, trees or planned, width, seed))
    near = _met(_dealt(reps, forest, dim), decoder, dim, k, min_cosine)
    near = near.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(f"r <= {k}").drop("r")
    shared = firsts.where("at = 2").select("vec").join(reps, "vec").select("vec", F.col("id").alias("rep"))
    members = shared.join(entries, "vec").select("rep", F.col("id").alias("id"))
    heads = firsts.join(shared, "vec").select("rep", F.col("id").alias("other"))
    solo = F.coalesce("other", "b")
    spread = near.join(heads, near.b == heads.rep, "left").select(F.col("a").alias("rep"), solo.alias("other"), "cosine")
    listed = spread.union(heads.select("rep", "other", F.lit(1.0)))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "other"))).where(f"r <= {k + 1}").drop("r")
    per_id = listed.join(members, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "other", "cosine").where("id <> other")
    return per_id.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(f"place <= {k}")


#: Bytes of query vectors that a task may hold beside its rows.
QUERY_BYTES = 64 << 20


def search(entries: DataFrame, queries: DataFrame, decoder: Decoder, k: int = 10) -> DataFrame:
    """(id, other, cosine, place): the exact k most similar entries of every query but itself, best
    first, ties by the lesser id.

    entries and queries: (id, vec). The query set is cut into blocks of QUERY_BYTES; each is
    scanned over the entries where they lie, without a shuffle of the entries.
    """
    dim = len(decoder.lows)
    per = max(1, QUERY_BYTES // (dim * 12))
    blocks = int(-(-queries.count() // per)) or 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    parts = [_scanned(entries, queries if blocks == 1 else queries.where(block == b), decoder, dim, k) for b in range(blocks)]
    each = parts[0]
    for part in parts[1:]:
        each = each.union(part)
    w = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "other")
    return each.withColumn("place", F.row_number().over(w)).where(f"place <= {k}")


def _scanned(entries: DataFrame, queries: DataFrame, decoder: Decoder, dim: int, k: int) -> DataFrame:
    rows = queries.select("id", "vec").collect()  # at most about QUERY_BYTES
    asked = entries.sparkSession.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), np.frombuffer(b"".join(bytes(r.vec) for r in rows), np.int8).reshape(-1, dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes = asked.value
        cell, unit = Cell(decoder, dim, k, -2.0), decoder.unit(codes)
        best: tuple = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(-1, dim)
            found = [best, *cell._each(ids, codes, batch.column(0).to_numpy(), own, unit, decoder.unit(own))]
            a, b, c = (np.concatenate(x) for x in zip(*found))
            keep = _best(a, b, c, k)
            best = a[keep], b[keep], c[keep]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["id", "other", "cosine"])

    return entries.select("id", "vec").mapInArrow(run, "id long, other long, cosine double")
