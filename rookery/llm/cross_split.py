"""Overlaps between evaluation and training texts by Aho-Corasick automata.

Passages are five-character grams of normalised evaluation texts. All grams have one order, rare
to frequent (by a fixed-size count sketch). Of a text with n distinct grams the first
n - ceil(t * n) + extra count, extra = ceil(EXTRA * n). Two texts of m and n grams whose sets reach
Jaccard t share at least o = t / (1 + t) * (m + n); the first `extra` shared ones (the lesser extra
of the two) stand, in either text, before place size - o + extra, so each match is only followed
to evaluation texts of sizes and places that still allow o. Evaluation texts are sharded by size; a
shard's passages form one automaton, which scans whole every training text whose size fits the
shard. Pairs with enough matches are compared exactly, so none is lost and none is false; the
matched intervals of a pair are merged to the characters of the evaluation text they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.near_duplicates import count_sketch
from rookery.session import materialise

GRAM = 5
EXTRA = 0.03
MIN_CHARS = 20
#: Characters of evaluation texts in a shard, and of training texts that meet it in one task.
SHARD_CHARS = 8 << 20
BLOCK_CHARS = 12 << 20
#: Sizes are alike for a shard if their logarithms to base 1/t share the first so many halves.
SIZE_STEPS = 2
BATCH_TEXTS = 128
_CODE_BITS = 27  # codes are below 37^5
_ALPHABET = " 0123456789abcdefghijklmnopqrstuvwxyz"
_CODE = np.full(256, 0, np.int64)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(len(_ALPHABET))
_POWERS = len(_ALPHABET) ** np.arange(GRAM - 1, -1, -1)


def normalised(text) -> F.Column:
    """Lower case, runs of other characters than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code of the gram at each position of normalised texts, flat, and the row of each."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    code = _CODE[np.frombuffer("".join(texts).encode(), np.uint8)]
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(texts)), lengths)
    whole = np.arange(len(code)) + GRAM <= ends[row]
    m = max(0, len(code) - GRAM + 1)
    flat = sum(code[j : j + m] * _POWERS[j] for j in range(GRAM)) if m else np.empty(0, np.int64)
    return flat[whole[:m]], row[:m][whole[:m]]


def gram_texts(codes: np.ndarray) -> list[str]:
    """The grams of codes."""
    letters = np.frombuffer(_ALPHABET.encode(), np.uint8)
    flat = letters[codes[:, None] // _POWERS % len(_ALPHABET)].tobytes().decode()
    return [flat[i : i + GRAM] for i in range(0, len(flat), GRAM)]


def ordered_sets(texts: list[str], rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct gram codes of each text, rare to frequent, flat, and the bounds of the texts."""
    code, row = codes_of(texts)
    key = np.sort((row << (_CODE_BITS + 8)) | (rarity[code & (len(rarity) - 1)].astype(np.int64) << _CODE_BITS) | code)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    bounds = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << (_CODE_BITS + 8))
    return (key & ((1 << _CODE_BITS) - 1)).astype(np.int32), bounds


def _gram_rows(texts: DataFrame) -> DataFrame:
    """(g): the gram codes of each text as a list, for the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, row = codes_of(batch.column(0).to_pylist())
            offsets = np.searchsorted(row, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code))], names=["g"])

    return texts.select("norm").mapInArrow(run, "g array<long>")


def _sized(texts: DataFrame, rarity, step: float) -> DataFrame:
    """(cls, norm, band): the size band of each text's set of grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds = ordered_sets(batch.column(1).to_pylist(), rarity.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_band(np.diff(bounds), step))], names=["cls", "norm", "band"])

    return texts.select("cls", "norm").mapInArrow(run, "cls string, norm string, band int")


def _band(sizes: np.ndarray, step: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / step + 1e-9).astype(np.int32)


def _ranges(lo: np.ndarray, length: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each range put together."""
    return np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())


def _counting(sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """How many of a text's grams count, and its extra."""
    extra = np.ceil(EXTRA * sizes).astype(np.int64)
    return np.minimum(sizes, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + extra), extra


class Shard:
    """The automaton of a shard's passages, and for each the evaluation texts that hold it, by size."""

    def __init__(self, texts: list[str], threshold: float, rarity: np.ndarray):
        import ahocorasick

        self.texts, self.threshold, self.rarity = texts, threshold, rarity
        self.least = threshold / (1 + threshold)
        self.grams, self.bounds = ordered_sets(texts, rarity)
        self.sizes = np.diff(self.bounds)
        count, self.extra = _counting(self.sizes, threshold)
        owner = np.repeat(np.arange(len(texts)), count)
        place = _ranges(np.zeros(len(texts), np.int64), count)
        code = self.grams[self.bounds[owner] + place].astype(np.int64)
        order = np.lexsort((self.sizes[owner], code))
        owner, place, code = owner[order], place[order], code[order]
        self.words, self.start = np.unique(code, return_index=True)
        self.start = np.append(self.start, len(code))
        self.owner = owner.astype(np.int32)
        #: Postings by word and size, and the greatest size a partner may have at that place.
        self.key = (np.repeat(np.arange(len(self.words)), np.diff(self.start)) << 32) + self.sizes[owner]
        self.most = self._partner(self.sizes[owner], self.extra[owner], place).astype(np.int32)
        self.machine = ahocorasick.Automaton()
        for i, gram in enumerate(gram_texts(self.words)):
            self.machine.add_word(gram, i)
        self.machine.make_automaton()
        self.mark = np.zeros(len(_ALPHABET) ** GRAM, bool)

    def _partner(self, size, extra, place):
        """The greatest size of a partner with which a shared gram at that place is among the first."""
        top = np.floor(((1 - self.least) * size + extra - 1 - place) / self.least + 1e-6)
        return np.maximum(0, np.minimum(top, np.floor(size / self.threshold + 1e-9)))

    def scan(self, texts: list[str]) -> Iterator[tuple[int, int, float, float]]:
        """(training text, evaluation text, similarity, share of its characters covered) of similar ones."""
        flat, bounds = ordered_sets(texts, self.rarity)
        sizes = np.diff(bounds)
        count, extra = _counting(sizes, self.threshold)
        row = np.repeat(np.arange(len(texts)), count)
        place = _ranges(np.zeros(len(texts), np.int64), count)
        code = flat[bounds[row] + place].astype(np.int64)
        word = np.minimum(np.searchsorted(self.words, code), max(0, len(self.words) - 1))
        seen = np.zeros(len(word), bool)
        at = np.searchsorted(row, np.arange(len(texts) + 1))
        matched = np.zeros(len(self.words), bool)
        for r, text in enumerate(texts):  # what the automaton finds in the whole text, of what counts
            hits = [w for _, w in self.machine.iter(text)]
            matched[hits] = True
            seen[at[r] : at[r + 1]] = matched[word[at[r] : at[r + 1]]]
            matched[hits] = False
        seen &= self.words[word] == code if len(self.words) else False
        kept = np.flatnonzero(seen)
        kept = kept[np.argsort(word[kept])]  # neighbouring searches touch neighbouring postings
        row, place, word = row[kept], place[kept], word[kept]
        m = sizes[row]
        lo = np.searchsorted(self.key, (word << 32) + np.ceil(self.threshold * m - 1e-9).astype(np.int64))
        hi = np.searchsorted(self.key, (word << 32) + self._partner(m, extra[row], place).astype(np.int64), "right")
        length = np.maximum(hi - lo, 0)
        posting = _ranges(lo, length)
        of = np.repeat(row, length)
        fits = self.most[posting] >= sizes[of]
        pair, met = np.unique(of[fits] * len(self.texts) + self.owner[posting[fits]], return_counts=True)
        t, e = pair // len(self.texts), pair % len(self.texts)
        enough = met >= np.maximum(1, np.minimum(extra[t], self.extra[e]))
        t, e = t[enough], e[enough]
        for r in np.unique(t).tolist():
            own = flat[bounds[r] : bounds[r + 1]]
            self.mark[own] = True
            yield from self._compare(r, len(own), e[t == r])
            self.mark[own] = False

    def _compare(self, r: int, m: int, others: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        n = self.sizes[others]
        shared = np.add.reduceat(self.mark[self.grams[_ranges(self.bounds[others], n)]], np.cumsum(n) - n, dtype=np.int64)
        similarity = shared / (m + n - shared)
        for e, s in zip(others.tolist(), similarity.tolist()):
            if s >= self.threshold - 1e-12:
                code, _ = codes_of([self.texts[e]])
                starts = np.flatnonzero(self.mark[code])
                yield r, e, s, (GRAM + int(np.minimum(np.diff(starts), GRAM).sum())) / len(self.texts[e])


def shard_bands(bands: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(first band, last band, parts) of shards from (band, characters): neighbouring bands are put
    together up to `most` characters; a band with more is cut into parts by hash."""
    shards: list[tuple[int, int, int]] = []
    held = 0
    for band, chars in sorted(bands):
        if shards and held + chars <= most:
            shards[-1] = (shards[-1][0], band, 1)
            held += chars
        else:
            shards.append((band, band, -(-chars // most)))
            held = chars
    return shards


def one_key_each(spark, slots: int) -> list[int]:
    """For each of `slots` hash partitions the least number that falls into it, so that no task
    gets several groups while others get none."""
    tried, out = 64, {}
    while len(out) < slots:
        tried *= 2
        ids = spark.range(tried * slots).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(slots)).alias("slot"))
        out = {r.slot: r.k for r in ids.groupBy("slot").agg(F.min("k").alias("k")).collect()}
    return [out[i] for i in range(slots)]


def overlapping_texts(train: DataFrame, evaluation: DataFrame, threshold: float) -> DataFrame:
    """(train_cls, eval_cls, similarity, covered) from two tables (cls, norm) of distinct texts.

    covered: the share of the evaluation text's characters under passages of the training text.
    """
    spark = train.sparkSession
    rarity = spark.sparkContext.broadcast(count_sketch(_gram_rows(train.select("norm").union(evaluation.select("norm"))), "g"))
    step = float(-np.log(threshold)) / SIZE_STEPS
    train, evaluation = materialise(_sized(train, rarity, step)), materialise(_sized(evaluation, rarity, step))
    held = evaluation.groupBy("band").agg(F.sum(F.length("norm")).alias("chars"))  # a few dozen bands
    shards = shard_bands([(r.band, r.chars) for r in held.collect()], SHARD_CHARS)
    numbers, first = [], 0
    for low, high, parts in shards:
        numbers.append((first, parts, low, high))
        first += parts
    chars = train.agg(F.sum(F.length("norm")).alias("c")).first().c or 0
    blocks = max(int(chars // BLOCK_CHARS) + 1, -(-min(spark.sparkContext.defaultParallelism, int(chars // (1 << 18)) + 1) // max(1, first)))
    reach = SIZE_STEPS + 1
    lists = F.array(*[F.struct(*[F.lit(int(v)).alias(c) for c, v in zip(("first", "parts", "low", "high"), x)]) for x in numbers]) if numbers else F.expr("cast(array() as array<struct<first: int, parts: int, low: int, high: int>>)")
    fits = F.filter(lists, lambda s: (s["low"] <= F.col("band") + reach) & (s["high"] >= F.col("band") - reach))
    visits = F.flatten(F.transform(fits, lambda s: F.sequence(s["first"], s["first"] + s["parts"] - 1)))
    own = F.get(F.filter(lists, lambda s: (s["low"] <= F.col("band")) & (s["high"] >= F.col("band"))), F.lit(0))
    scanned = train.select("cls", "norm", F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int").alias("block"), F.explode(visits).alias("shard"))
    dealt = evaluation.select("cls", "norm", (own["first"] + F.pmod(F.xxhash64("cls"), own["parts"]).cast("int")).alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[str, str, float, float]] = []
        if left.num_rows and right.num_rows:
            names, shard = right.column("cls").to_pylist(), Shard(right.column("norm").to_pylist(), threshold, rarity.value)
            for at in range(0, left.num_rows, BATCH_TEXTS):
                cls = left.column("cls").slice(at, BATCH_TEXTS).to_pylist()
                for r, e, similarity, covered in shard.scan(left.column("norm").slice(at, BATCH_TEXTS).to_pylist()):
                    out.append((cls[r], names[e], similarity, covered))
        cols = list(zip(*out)) if out else [(), (), (), ()]
        return pa.table({"train_cls": pa.array(cols[0], pa.string()), "eval_cls": pa.array(cols[1], pa.string()), "similarity": pa.array(cols[2], pa.float64()), "covered": pa.array(cols[3], pa.float64())})

    slots = max(1, first) * blocks
    keys = F.array(*[F.lit(k) for k in one_key_each(spark, slots)])
    group = F.get(keys, F.col("block") * F.lit(max(1, first)) + F.col("shard"))
    return (
        scanned.withColumn("group", group).repartition(slots, "group").groupBy("group")
        .cogroup(dealt.withColumn("group", group).repartition(slots, "group").groupBy("group"))
        .applyInArrow(meet, "train_cls string, eval_cls string, similarity double, covered double")
    )


def cross_split_overlaps(train: DataFrame, evaluation: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(train_key, eval_key, split, source, similarity, covered): every pair of a training and an
    evaluation record whose sets of five-character grams reach the threshold.

    train: (key, text); evaluation: (key, text, split, source); other columns are ignored. Null
    texts and those with fewer than MIN_CHARS characters after normalising take no part. Equal
    texts are scanned once and expanded at the end; repeated records count once. Empty tables
    give no pairs.
    """
    usable = F.length("norm") >= MIN_CHARS
    tr = materialise(train.select("key", normalised(F.col("text")).alias("norm")).where(usable).withColumn("cls", F.sha2("norm", 256)))
    ev = materialise(evaluation.select("key", "split", "source", normalised(F.col("text")).alias("norm")).where(usable).withColumn("cls", F.sha2("norm", 256)))
    pairs = overlapping_texts(tr.select("cls", "norm").distinct(), ev.select("cls", "norm").distinct(), threshold)
    return (
        pairs.join(tr.select(F.col("cls").alias("train_cls"), F.col("key").alias("train_key")).distinct(), "train_cls")
        .join(ev.select(F.col("cls").alias("eval_cls"), F.col("key").alias("eval_key"), "split", "source").distinct(), "eval_cls")
        .select("train_key", "eval_key", "split", "source", "similarity", "covered")
    )


def overlap_report(overlaps: DataFrame) -> DataFrame:
    """(split, source, eval_records, train_records, pairs): what overlaps, per split and source
    of the evaluation record; nulls are groups of their own."""
    return overlaps.groupBy("split", "source").agg(
        F.count_distinct("eval_key").alias("eval_records"), F.count_distinct("train_key").alias("train_records"), F.count("*").alias("pairs")
    )
