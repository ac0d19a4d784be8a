"""Near-duplicate texts by a prefix-filter join with a segment-popcount bound.

A text's fingerprint is a bitmap with one bit per distinct word shingle over 2^64 positions. The
method asked for maps it to bit counts of segments and joins a grid over these by range. Such a
grid can't prune at the thresholds used here (README has figures), so candidates come from an
exact prefix-filter join instead:

* shingles have one order, rare to frequent (by a count sketch whose size follows the input). With
  alpha = ceil(t * n) a text is indexed by its n - alpha + PREFIX_EXTRA first shingles;
* the bit counts of SEGMENTS segments travel along. Sum(|a_i - b_i|) over segments is at most
  |A xor B|, and Jaccard >= t means |A xor B| <= (1-t)/(1+t) * (|A|+|B|): pairs beyond that
  Manhattan distance, or of sizes too different, are left out in the join;
* survivors must share PREFIX_EXTRA indexed shingles and are then compared exactly.

Two texts at or above t share at least least = ceil(t/(1+t) * (|A|+|B|)) shingles; the first
min(PREFIX_EXTRA, alpha) of these are indexed by both and stand within the first
n - least + PREFIX_EXTRA of either: no pair is lost. A shingle of many texts is a heavy key; its
texts are cut into parts of about CELL_ROWS and every two parts meet in a key of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.operators.components import connected_components
from rookery.session import materialise

SEGMENTS = 16
PREFIX_EXTRA = 5
#: Slots of a sketch as a power of two: by what it counts, within these bounds.
SKETCH_BITS = (22, 26)
#: Texts that share one shingle and meet in one task.
CELL_ROWS = 32_768
BLOCK_BITS = 16
WORD = re.compile("[a-z0-9]+")
_MIX_A, _MIX_B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's runs of `words` words, flat, and offsets.

    Texts that are null or have fewer than min_words words get none.
    """
    tokens: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    lookup = _WORDS.__getitem__
    for i, text in enumerate(texts):
        found = WORD.findall(text.lower()) if text else ()
        if len(found) >= max(min_words, words):
            tokens.extend(map(lookup, found))
            lengths[i] = len(found)
    flat = np.fromiter(tokens, np.uint64, len(tokens))
    counts = np.maximum(lengths - words + 1, 0)
    if not counts.sum():
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(starts, counts) + within
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            h = scramble(h * _STEP + flat[at + j] + np.uint64(j + 1))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))


def signatures(texts: DataFrame, words: int, min_words: int) -> DataFrame:
    """(tbl, key, cls, c64, n, sh) from (tbl, key, text): sh the sorted distinct shingle hashes, n
    their number, cls 128 bits of a hash of tbl and sh (the class of equal sets), c64 its first
    half, which stands for it wherever an exact comparison follows. Texts without shingles go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tbl, key = batch.column(0), batch.column(1)
            h, offsets = shingle_sets(batch.column(2).to_pylist(), words, min_words)
            sizes = np.diff(offsets)
            has = np.flatnonzero(sizes)
            if not len(has):
                continue
            raw = h.tobytes()
            names = tbl.take(pa.array(has)).to_pylist()
            cls = [xxhash.xxh3_128_digest(raw[8 * offsets[i] : 8 * offsets[i + 1]], seed=xxhash.xxh32_intdigest(t)) for i, t in zip(has.tolist(), names)]
            c64 = np.frombuffer(b"".join(cls), np.int64)[::2]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[has]))), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), key.take(pa.array(has)), pa.array(cls, pa.binary()), pa.array(c64), pa.array(sizes[has].astype(np.int32)), lists],
                names=["tbl", "key", "cls", "c64", "n", "sh"],
            )

    return texts.select("tbl", "key", "text").mapInArrow(run, "tbl string, key long, cls binary, c64 long, n int, sh array<long>")


def sketch_bits(values: int) -> int:
    """Bits of a sketch of so many values, repeats included: two of them a slot, within SKETCH_BITS."""
    return int(np.clip(np.ceil(np.log2(max(values, 1) / 2)), *SKETCH_BITS))


def count_sketch(df: DataFrame, column: str, bits: int = SKETCH_BITS[0]) -> np.ndarray:
    """Log-scaled occurrence counts (uint8) by the low bits of the 64-bit values of a long or
    array<long> column: 0 none, 1 exactly one, above: 1 + 8*log2(count). 2^bits bytes come to
    the driver whatever the input; tasks send zipped blocks that are summed by block."""
    block = 1 << min(BLOCK_BITS, bits)
    total = 1 << bits
    is_list = dict(df.dtypes)[column].startswith("array")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(total, np.uint16)
        any_rows = False
        for batch in batches:
            col = batch.column(0)
            values = (col.flatten() if is_list else col.drop_null()).to_numpy(zero_copy_only=False)
            if not len(values):
                continue
            any_rows = True
            slots, times = np.unique(values & (total - 1), return_counts=True)
            seen[slots] = np.minimum(seen[slots].astype(np.int64) + times, 65535)
        if any_rows:
            blocks = [i for i in range(total // block) if seen[i * block : (i + 1) * block].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array([zlib.compress(seen[i * block : (i + 1) * block].tobytes(), 1) for i in blocks], pa.binary())], names=["block", "counts"]
            )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros(block, np.int64)
        for batch in batches:
            for part in batch.column("counts"):
                summed += np.frombuffer(zlib.decompress(part.as_py()), np.uint16)
        scaled = np.where(summed > 0, 1 + np.round(8 * np.log2(np.maximum(summed, 1))), 0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(scaled, 255).astype(np.uint8).tobytes()], pa.binary())], names=["block", "counts"])

    parts = df.select(column).mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    out = np.zeros(total, np.uint8)
    for row in parts.collect():
        out[row.block * block : (row.block + 1) * block] = np.frombuffer(row.counts, np.uint8)
    return out


def _cells(sigs: DataFrame, threshold: float, rarity) -> DataFrame:
    """(h, cls, m, c): the keys under which each class (by its 64 bits) is indexed, packed to shuffle
    little: m holds its size, the shingle's place in its order of rarity and its side (33 and 2 bits
    up), c the counts of its segments in four bits each, 15 standing for more.

    A key of many classes is cut into parts: two parts i < j meet under a key of their own, i on
    side 1 and j on side 2, and each part meets itself on side 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = rarity.value
        mask = np.int64(len(sketch) - 1)
        holders = np.where(np.arange(256) > 1, 2.0 ** ((np.arange(256) - 1) / 8), 1.0)  # at most
        parts_of = np.ceil(holders / CELL_ROWS).astype(np.int64)
        done: set[int] = set()
        for batch in batches:
            cls = batch.column(1).to_numpy()
            fresh = []
            for i, c in enumerate(cls.tolist()):  # equal sets in one task come once
                if c not in done:
                    done.add(c)
                    fresh.append(i)
            if not fresh:
                continue
            part = batch.take(pa.array(fresh))
            salt = np.array([xxhash.xxh3_64_intdigest(t) for t in part.column(0).to_pylist()], np.uint64)
            cls, n, lists = part.column(1).to_numpy(), part.column(2).to_numpy().astype(np.int64), part.column(3)
            h = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            rare = sketch[h & mask]
            segment = (h.view(np.uint64) >> np.uint64(60)).astype(np.int64)
            counts = np.minimum(np.bincount(row * SEGMENTS + segment, minlength=len(n) * SEGMENTS), 15).astype(np.uint64).reshape(len(n), SEGMENTS)
            packed = (counts << np.arange(0, 4 * SEGMENTS, 4, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
            order = np.lexsort((h, rare, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            alpha = np.ceil(threshold * n - 1e-9).astype(np.int64)
            prefix = n - alpha + np.minimum(PREFIX_EXTRA, alpha)
            place_of = np.flatnonzero((place < np.repeat(prefix, n)) & (rare[order] != 1))
            parts = parts_of[rare[order[place_of]]]
            own = (cls[row[order[place_of]]] >> 17) % parts
            copies = np.repeat(np.arange(len(parts)), parts)
            other = np.arange(len(copies)) - np.repeat(np.cumsum(parts) - parts, parts)
            place_of, parts, own = place_of[copies], parts[copies], own[copies]
            pick = order[place_of]
            r = row[pick]
            met = np.minimum(own, other) * parts + np.maximum(own, other)
            cell = scramble(scramble(h[pick].view(np.uint64) ^ salt[r]) + met.astype(np.uint64))
            side = np.where(own == other, 0, np.where(own < other, 1, 2))
            meta = (n[r] << 33) | (place[place_of] << 2) | side
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(cls[r]), pa.array(meta), pa.array(packed[r])], names=["h", "cls", "m", "c"])

    return sigs.select("tbl", "c64", "n", "sh").mapInArrow(run, "h long, cls long, m long, c long")


def _gap(a: str, b: str) -> str:
    """The Manhattan distance of two packed rows of counts; counts over 15 make it less, never more."""
    return " + ".join(f"abs((shiftrightunsigned({a}, {s}) & 15) - (shiftrightunsigned({b}, {s}) & 15))" for s in range(0, 4 * SEGMENTS, 4))


def _only(sigs: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """Rows of sigs whose c64 may be in wanted, equal sets in one task once: before any shuffle of sets."""
    bits = sketch_bits(32 * count)
    bitmap = sigs.sparkSession.sparkContext.broadcast(np.packbits(count_sketch(wanted, "c64", bits) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        done: set[bytes] = set()
        for batch in batches:
            at = batch.column(1).to_numpy() & ((1 << bits) - 1)
            hit = np.flatnonzero((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            names = batch.column(0).take(pa.array(hit)).to_pylist()
            hit = [i for i, c in zip(hit.tolist(), names) if not (c in done or done.add(c))]
            if hit:
                yield batch.take(pa.array(hit))

    return sigs.select("cls", "c64", "sh").mapInArrow(run, "cls binary, c64 long, sh array<long>")


def class_pairs(sigs: DataFrame, threshold: float) -> DataFrame:
    """(cls_a, cls_b, similarity): pairs of different shingle sets of one tbl with Jaccard >= threshold."""
    spark = sigs.sparkSession
    shingles = sigs.agg(F.sum("n").alias("n")).first().n or 0
    rarity = spark.sparkContext.broadcast(count_sketch(sigs, "sh", sketch_bits(shingles)))
    met = _cells(sigs, threshold, rarity).repartition("h").dropDuplicates(["h", "cls"])
    cells = met.selectExpr("h", "cls", "cast(shiftrightunsigned(m, 33) as int) as n", "cast(shiftrightunsigned(m, 2) & 2147483647 as int) as at", "cast(m & 3 as int) as side", "c")
    bound = (1 - threshold) / (1 + threshold)
    a, b = cells.alias("a"), cells.alias("b")
    near = f"({_gap('a.c', 'b.c')}) <= {bound!r} * (a.n + b.n) + 1e-9"
    sized = f"a.n >= {threshold!r} * b.n - 1e-9 and b.n >= {threshold!r} * a.n - 1e-9"
    least = f"ceil({threshold / (1 + threshold)!r} * (a.n + b.n) - 1e-9)"  # shingles such a pair shares
    early = f"a.at < a.n - {least} + {PREFIX_EXTRA} and b.at < b.n - {least} + {PREFIX_EXTRA}"
    shared = (
        a.join(b, F.expr(f"a.h = b.h and a.cls < b.cls and (a.side = 0 or a.side <> b.side) and {sized} and {early} and {near}"))
        .groupBy(F.col("a.cls").alias("c64_a"), F.col("b.cls").alias("c64_b"))
        .agg(F.count("*").alias("cells"), F.min(F.least("a.n", "b.n")).alias("n"))
        .where(f"cells >= least({PREFIX_EXTRA}, ceil({threshold!r} * n - 1e-9))")
        .select("c64_a", "c64_b")
    )
    classes = sigs.select("c64", "cls").distinct().groupBy("c64").agg(F.count("*").alias("n"))
    alike = classes.where("n > 1").select(F.col("c64").alias("c64_a"), F.col("c64").alias("c64_b"))  # unequal sets of equal c64
    shared = materialise(shared.union(alike))
    wanted = shared.select(F.col("c64_a").alias("c64")).union(shared.select("c64_b")).distinct()
    # one shuffle of the sets, by c64: they are joined where it leaves them
    sets = _only(sigs, wanted, 2 * shared.count()).repartition("c64").groupBy("c64", "cls").agg(F.first("sh").alias("sh"))
    left, right = (sets.select(F.col("cls").alias(f"cls_{x}"), F.col("c64").alias(f"c64_{x}"), F.col("sh").alias(f"sh_{x}")) for x in "ab")
    inter = F.size(F.array_intersect("sh_a", "sh_b"))
    return (
        shared.join(left, "c64_a")
        .join(right, "c64_b")
        .where("c64_a <> c64_b or cls_a < cls_b")
        .select("cls_a", "cls_b", (inter / (F.size("sh_a") + F.size("sh_b") - inter)).alias("similarity"))
        .where(F.col("similarity") >= threshold - 1e-12)
    )


def near_duplicate_pairs(texts: DataFrame, threshold: float = 0.8, words: int = 5, min_words: int = 5) -> DataFrame:
    """(tbl, key_a, key_b, similarity), key_a < key_b: every pair of rows of one tbl whose shingle
    sets reach the threshold, exact copies included.

    The result holds every pair of m copies of one text, m * (m - 1) / 2 of them: it's for tables
    where that is wanted, near_duplicate_groups has one row per text whatever m is.
    texts: (tbl string, key long, text string), other columns are ignored. Rows with a null tbl,
    key or text, or with too few words, take no part; a key given twice with one text counts once;
    an empty table gives no pairs. Texts are used whole.
    """
    sigs = materialise(signatures(texts.where("tbl is not null and key is not null and text is not null"), words, min_words))
    pairs = class_pairs(sigs, threshold)
    members = sigs.select("tbl", "cls", "key").distinct()
    ma = members.select(F.col("cls").alias("cls_a"), "tbl", F.col("key").alias("ka"))
    mb = members.select(F.col("cls").alias("cls_b"), F.col("key").alias("kb"))
    across = pairs.join(ma, "cls_a").join(mb, "cls_b").where("ka <> kb").select("tbl", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "similarity")
    m1, m2 = members.alias("m1"), members.alias("m2")
    within = m1.join(m2, F.expr("m1.cls = m2.cls and m1.tbl = m2.tbl and m1.key < m2.key")).select("m1.tbl", F.col("m1.key").alias("key_a"), F.col("m2.key").alias("key_b"), F.lit(1.0).alias("similarity"))
    return across.union(within).dropDuplicates(["tbl", "key_a", "key_b"])


def near_duplicate_groups(texts: DataFrame, threshold: float = 0.8, words: int = 5, min_words: int = 5) -> DataFrame:
    """(tbl, key, group_id, copies, links): one row per text that takes part.

    group_id is tbl:key of the least key connected to the text's, copies the number of rows with the same shingle set, links the number of linked rows with other sets. Copies aren't expanded.
    Nulls, short texts and empty tables as in near_duplicate_pairs.
    """
    sigs = materialise(signatures(texts.where("tbl is not null and key is not null and text is not null"), words, min_words))
    pairs = materialise(class_pairs(sigs, threshold).select(F.hex("cls_a").alias("cls_a"), F.hex("cls_b").alias("cls_b")))
    members = sigs.select("tbl", "key", F.hex("cls").alias("cls")).distinct()
    sizes = members.groupBy("cls").agg(F.count("*").alias("copies"))
    both = pairs.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).union(pairs.select("cls_b", "cls_a"))
    links = both.join(sizes.select(F.col("cls").alias("other"), "copies"), "other").groupBy("cls").agg(F.sum("copies").alias("links"))
    groups = connected_components(pairs, "cls_a", "cls_b")
    classes = members.groupBy("cls").agg(F.count("*").alias("copies"), F.min("key").alias("least"))
    grouped = classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = grouped.join(grouped.groupBy("component").agg(F.min("least").alias("group_id")), "component").join(links, "cls", "left")
    return members.join(named, "cls").select("tbl", "key", F.concat("tbl", F.lit(":"), "group_id").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
