"""Dense retrieval: exact and quantised top-k for a batch of queries."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions import vectors as V
from rookery.operators.lexical import best, top_k
from rookery.session import materialise

#: Bytes of queries that a task holds beside its items, and queries scored at a time.
QUERY_BYTES = 64 << 20
QUERY_ROWS = 1024
#: Rows an int8 calibration is fitted on.
CALIBRATION_ROWS = 50_000


def _flat(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _scanned_top_k(items: DataFrame, asked: DataFrame, read, kernel, width: Column, k: int) -> DataFrame:
    """(query, item, score): for every query and partition of the items its k least scores.

    items: (item, x), asked: (query, y); nulls in x and y take no part. read makes an array of a
    column, kernel scores queries against items, width is the bytes of a y. The queries are cut into blocks of QUERY_BYTES by
    their measured number; each block goes to the tasks, and the items are scanned where they lie:
    they are never shuffled, and only k rows per query leave a task.
    """
    spark = items.sparkSession
    asked, items = asked.where("y is not null"), items.where("x is not null")
    size = asked.agg(F.count("*").alias("n"), F.max(width).alias("w")).first()
    blocks = -(-size.n * 3 * max(1, size.w or 1) // QUERY_BYTES) or 1
    kinds = dict(items.select("item").dtypes) | dict(asked.select("query").dtypes)

    def scan(block: DataFrame) -> DataFrame:
        table = block.select("query", "y").toArrow().combine_chunks()  # at most about QUERY_BYTES
        queries = spark.sparkContext.broadcast((table.column("query").combine_chunks() if table.num_rows else None, read(table.column("y").combine_chunks()) if table.num_rows else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, y = queries.value
            if names is None:
                return
            rows, held, scores, least = np.empty(0, np.int64), None, np.empty(0), np.full(len(y), np.inf)
            for batch in batches:
                ids, x = batch.column(0), read(batch.column(1))
                found_rows, found_at, found = [rows], [np.arange(len(rows))], [scores]
                base = len(rows)
                for at in range(0, len(y), QUERY_ROWS):
                    s = kernel(y[at : at + QUERY_ROWS], x).astype(np.float64, copy=False)
                    keep = min(k, s.shape[1])
                    bound = least[at : at + QUERY_ROWS].copy()  # the k-th best so far, or of this batch
                    new = np.flatnonzero(np.isinf(bound))
                    if keep and len(new):
                        bound[new] = np.partition(s[new], keep - 1, axis=1)[:, keep - 1]
                    i, j = np.nonzero(s <= bound[:, None] + 2e-9)
                    found_rows.append(i + at), found_at.append(j + base), found.append(s[i, j])
                rows, at, scores = np.concatenate(found_rows), np.concatenate(found_at), np.concatenate(found)
                pool = ids if held is None else pa.concat_arrays([held, ids])
                rank = np.unique(pool.to_numpy(zero_copy_only=False), return_inverse=True)[1]
                kept = best(rows, rank[at], scores, k)
                rows, scores, held = rows[kept], scores[kept], pool.take(pa.array(at[kept]))
                full = np.flatnonzero(np.bincount(rows, minlength=len(y)) == k)
                if k:
                    least[full] = scores[np.searchsorted(rows, full, "right") - 1]
            if len(rows):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), held, pa.array(scores)], names=["query", "item", "score"])

        return items.select("item", "x").mapInArrow(run, f"query {kinds['query']}, item {kinds['item']}, score double")

    if blocks == 1:
        return scan(asked)
    items = materialise(items.select("item", "x"))  # a model's vectors aren't made again for each block
    number = F.pmod(F.xxhash64("query"), F.lit(blocks))
    return functools.reduce(DataFrame.union, [scan(asked.where(number == b)) for b in range(blocks)])


def exact_top_k(corpus: DataFrame, item: str, vec: str, queries: DataFrame, query: str, qvec: str, k: int, exclude_self: bool = False) -> DataFrame:
    """(query, item, score, rank): the k items with the greatest inner product, rank from 0, ties
    by the lesser item. k beyond the corpus gives the whole corpus."""
    items = corpus.select(F.col(item).alias("item"), V.as_doubles(F.col(vec)).alias("x"))
    asked = queries.select(F.col(query).alias("query"), V.as_doubles(F.col(qvec)).alias("y"))
    near = _scanned_top_k(items, asked, _flat, lambda y, x: -(y @ x.T), 8 * F.size("y"), k + int(exclude_self)).withColumn("score", -F.col("score"))
    return top_k(near.where("query <> item") if exclude_self else near, k, "query", "item")


def hamming_top_k(codes: DataFrame, item: str, code: str, queries: DataFrame, query: str, qcode: str, k: int) -> DataFrame:
    """(query, item, hamming, rank): the k nearest codes (bigint), ties by the lesser item."""
    items = codes.select(F.col(item).alias("item"), F.col(code).alias("x"))
    asked = queries.select(F.col(query).alias("query"), F.col(qcode).alias("y"))
    near = _scanned_top_k(items, asked, lambda c: c.to_numpy().view(np.uint64), lambda y, x: np.bitwise_count(y[:, None] ^ x[None, :]), F.lit(8), k)
    w = Window.partitionBy("query").orderBy("score", "item")
    return near.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("query", "item", F.col("score").cast("int").alias("hamming"), "rank")


def calibrate_int8(vectors: DataFrame, vec: str, item: str, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """One row (lows, spans, dim, n): percentiles per dimension, a span of 0 becomes 1.

    They are exact for up to CALIBRATION_ROWS vectors; of more, a calibration is fitted on about so
    many, every so many-th by a hash of the item. All vectors are encoded with it.
    """
    stride = -(-vectors.count() // CALIBRATION_ROWS)
    sample = vectors if stride <= 1 else vectors.where(F.pmod(F.xxhash64(item), F.lit(stride)) == 0)
    per = (
        sample.select(F.posexplode(V.as_doubles(F.col(vec))).alias("d", "x"))
        .groupBy("d")
        .agg(F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("p"), F.count("*").alias("n"))
        .select("d", F.col("p")[0].alias("low"), F.when(F.col("p")[1] == F.col("p")[0], 1.0).otherwise(F.col("p")[1] - F.col("p")[0]).alias("span"), "n")
    )
    rows = F.array_sort(F.collect_list(F.struct("d", "low", "span")))  # one entry per dimension
    return per.agg(rows.alias("r"), F.count("*").cast("int").alias("dim"), F.max("n").alias("n")).select(
        F.transform("r", lambda x: x["low"]).alias("lows"), F.transform("r", lambda x: x["span"]).alias("spans"), "dim", "n"
    )


def with_calibration(df: DataFrame, calibration: DataFrame) -> DataFrame:
    """df with the one calibration row's lows and spans."""
    return df.join(F.broadcast(calibration.select("lows", "spans")), how="inner")


def rescore(candidates: DataFrame, query: str, item: str, codes: DataFrame, queries: DataFrame, qvec: str, calibration: DataFrame, k: int) -> DataFrame:
    """(query, item, score, hamming, rank): decoded int8 codes against the float query."""
    decoded = with_calibration(codes.select(item, "code8"), calibration).select(item, V.int8_decode(F.col("code8"), F.col("lows"), F.col("spans")).alias("v"))
    scored = candidates.join(decoded, item).join(queries.select(query, F.col(qvec).alias("q")), query).select(query, item, "hamming", V.dot(F.col("v"), F.col("q")).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def encode_codes(vectors: DataFrame, item: str, vec: str, calibration: DataFrame) -> DataFrame:
    """(item, code1, code8): what an index stores of each vector."""
    v = V.as_doubles(F.col(vec))
    return with_calibration(vectors, calibration).select(F.col(item).alias("item"), V.binary_word(v).alias("code1"), V.int8_encode(v, F.col("lows"), F.col("spans")).alias("code8"))


def cascade(codes: DataFrame, queries: DataFrame, query: str, qvec: str, calibration: DataFrame, candidates: int = 500, k: int = 10) -> DataFrame:
    """Two stages over stored codes (item, code1, code8): `candidates` codes by Hamming distance, for
    which only code1 is read, and the k best of them by int8 score, for which code8 is fetched."""
    asked = queries.select(F.col(query).alias("query"), V.as_doubles(F.col(qvec)).alias("qv")).withColumn("qc", V.binary_word(F.col("qv")))
    near = materialise(hamming_top_k(codes, "item", "code1", asked, "query", "qc", candidates).drop("rank"))
    wanted = codes.join(near.select("item").distinct(), "item", "left_semi")
    return rescore(near, "query", "item", wanted, asked, "qv", calibration, k)


def to_half(df: DataFrame, vec: str, out: str = "half") -> DataFrame:
    """df with vec rounded to half precision."""

    @F.arrow_udf("array<float>")
    def rounded(v: pa.Array) -> pa.Array:
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=v.is_null())

    return df.withColumn(out, rounded(F.col(vec)))


def late_fetch(hits: DataFrame, source: DataFrame, on: list[str], text: str = "text") -> DataFrame:
    """hits with the text slice [char_start, char_end) of their source row; a missing row leaves null."""
    return hits.join(source.select(*on, F.col(text).alias("__t")), on, "left").withColumn("text", F.expr("substring(__t, char_start + 1, char_end - char_start)")).drop("__t")


def memory_report(spark, sizes: list[tuple[int, int]]) -> DataFrame:
    """Bytes per precision for (n_vectors, dim) pairs."""
    n, d = F.col("n_vectors"), F.col("dim")
    binary = F.floor(n * d / 8)
    return spark.createDataFrame(sizes, "n_vectors long, dim int").select(
        "n_vectors", "dim", F.round(n * d * 4 / 1e9, 2).alias("float32_gb"), F.round(n * d * 2 / 1e9, 2).alias("float16_gb"), F.round(n * d / 1e9, 2).alias("int8_gb"), F.round(binary / 1e9, 3).alias("binary_gb"),
        F.when(binary > 0, F.concat(F.round(n * d * 4 / F.when(binary > 0, binary)).cast("int").cast("string"), F.lit("x"))).otherwise("n/a").alias("binary_reduction"),
    )


def matryoshka_memory(spark, n_vectors: int, dims: tuple[int, ...] = (768, 512, 256, 128, 64)) -> DataFrame:
    d = F.col("dim").cast("long")  # n_vectors * d * 4 passes 2^31 from 700,000 vectors of 768 on
    return spark.createDataFrame([(int(x),) for x in dims], "dim int").select(
        "dim", F.round(n_vectors * d * 4 / 1e9, 2).alias("float32_gb"), F.round(n_vectors * d / 8 / 1e9, 3).alias("binary_gb"), F.concat(F.bround(dims[0] / d).cast("int").cast("string"), F.lit("x smaller")).alias("vs_full")
    )


def colbert_storage(spark, n_chunks: int, tokens_per_chunk: int = 350, dim: int = 128, bits: int = 2) -> DataFrame:
    n = F.lit(n_chunks).cast("long")
    t = n * tokens_per_chunk
    return spark.range(1).select(
        n.alias("n_chunks"), t.alias("n_token_vectors"), F.round(n * dim / 8 / 1e9, 2).alias("chunk_level_binary_gb"), F.round(t * dim * 2 / 1e9, 1).alias("token_level_float16_gb"),
        F.round(t * dim * bits / 8 / 1e9, 1).alias("token_level_compressed_gb"), F.concat(F.bround(t * bits / n).cast("long").cast("string"), F.lit("x")).alias("blowup_vs_chunk_binary"),
    )


def max_sim(query_tokens: DataFrame, passage_tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query, passage, score): sum over query tokens of their best dot product in the passage.

    query_tokens: (query, qt, v); passage_tokens: (passage, pt, v); pairs: (query, passage), the
    candidates of a first stage. Each side's tokens are gathered to one row first (a text has few),
    so a pair is one row and its score an expression. A pair with an empty side scores 0.
    """
    q = query_tokens.groupBy("query").agg(F.collect_list("v").alias("qs"))
    p = passage_tokens.groupBy("passage").agg(F.collect_list("v").alias("ps"))
    best = F.transform("qs", lambda a: F.array_max(F.transform("ps", lambda b: V.dot(a, b))))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return pairs.join(q, "query", "left").join(p, "passage", "left").select("query", "passage", F.coalesce(total, F.lit(0.0)).alias("score"))


def max_sim_explained(query_tokens: DataFrame, passage_tokens: DataFrame, pairs: DataFrame, top: int = 6) -> DataFrame:
    """(query, passage, qt, pt, similarity, rank): the best matched query tokens and their passage tokens."""
    q, p = query_tokens.select("query", "qt", F.col("v").alias("qv")), passage_tokens.select("passage", "pt", F.col("v").alias("pv"))
    sims = pairs.join(q, "query").join(p, "passage").select("query", "passage", "qt", "pt", F.round(V.dot(F.col("qv"), F.col("pv")), 9).alias("s"))
    best = sims.groupBy("query", "passage", "qt").agg(F.max(F.struct(F.col("s"), (-F.col("pt")).alias("n"))).alias("m")).select("query", "passage", "qt", (-F.col("m.n")).alias("pt"), F.col("m.s").alias("similarity"))
    w = Window.partitionBy("query", "passage").orderBy(F.desc("similarity"), "qt")
    return best.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < top)


def pairwise_diversity(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, diversity): mean 1 - cosine over unordered pairs of unit vectors; under two gives 0.

    The sum of all pairs' dot products is (|sum v|^2 - sum |v|^2) / 2, so no pair is formed.
    """
    each = vectors.select(F.col(group).alias("group"), V.as_doubles(F.col(vec)).alias("v"))
    squares = each.groupBy("group").agg(F.sum(V.dot(F.col("v"), F.col("v"))).alias("own"), F.count("*").alias("n"))
    sums = each.select("group", F.posexplode("v").alias("d", "x")).groupBy("group", "d").agg(F.sum("x").alias("s")).groupBy("group").agg(F.sum(F.col("s") * F.col("s")).alias("whole"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return squares.join(sums, "group").select("group", F.when(F.col("n") < 2, 0.0).otherwise(1 - (F.col("whole") - F.col("own")) / 2 / F.when(pairs > 0, pairs)).alias("diversity"))


def mean_of_means(scores: DataFrame, prompt: str, score: str) -> DataFrame:
    """One row: the mean of each prompt's mean score."""
    return scores.groupBy(prompt).agg(F.avg(score).alias("m")).agg(F.avg("m").alias("value"))


def concept_fidelity(made: DataFrame, prompt: str, vec: str, real: DataFrame, real_vec: str) -> DataFrame:
    """One row (value): the mean over prompts of the mean cosine of what was made for it to the
    concept, the unit centre of the real vectors. All vectors are brought to unit length."""
    mean = real.select(F.posexplode(V.l2_normalise(V.as_doubles(F.col(real_vec)))).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x"))
    concept = mean.agg(V.l2_normalise(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"])).alias("concept"))  # one entry per dimension
    each = made.select(prompt, V.l2_normalise(V.as_doubles(F.col(vec))).alias("u")).join(F.broadcast(concept), how="inner")
    return mean_of_means(each.select(prompt, V.dot(F.col("u"), F.col("concept")).alias("score")), prompt, "score")
