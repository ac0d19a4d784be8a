"""Rank fusion, reranking, context blocks and grounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import citations

RRF_K, CANDIDATES = 60, 20
BLOCK_GAP = "\n\n---\n\n"


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = RRF_K, candidates: int = CANDIDATES) -> DataFrame:
    """(query, item, rrf_score, dense_rank, bm25_rank, rank): sum of 1 / (rrf_k + rank), ranks from 0.

    Arms are (query, item, rank), each cut to `candidates`. Ties keep the dense order, then BM25's. They
    are brought together by query, which both the sums and the ranks can use: one shuffle instead of two.
    """
    arms = dense.where(F.col("rank") < candidates).select("query", "item", F.col("rank").alias("d"), F.lit(None).cast("int").alias("l")).unionByName(
        lexical.where(F.col("rank") < candidates).select("query", "item", F.lit(None).cast("int").alias("d"), F.col("rank").alias("l"))
    )
    both = arms.repartition("query").groupBy("query", "item").agg(F.max("d").alias("dense_rank"), F.max("l").alias("bm25_rank"))
    score = F.coalesce(1 / (rrf_k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1 / (rrf_k + F.col("bm25_rank")), F.lit(0.0))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("rrf_score", 12)), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    return both.withColumn("rrf_score", score).withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def single_arm(arm: DataFrame, k: int, dense: bool) -> DataFrame:
    """One arm in the fused layout: its score as rrf_score, the other rank null."""
    none = F.lit(None).cast("int")
    return arm.where(F.col("rank") < k).select(
        "query", "item", F.col("score").alias("rrf_score"), (F.col("rank") if dense else none).alias("dense_rank"), (none if dense else F.col("rank")).alias("bm25_rank"), "rank"
    )


def rerank(hits: DataFrame, score: Column, top_k: int | None) -> DataFrame:
    """hits re-ordered by score per query and cut to top_k; None or 0 keeps all."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("rerank_score", 9)), F.col("item"))
    ranked = hits.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(w) - 1)
    return ranked.where(F.col("rank") < top_k) if top_k else ranked


def arms_of(mode: str) -> tuple[bool, bool]:
    """Whether a mode needs the dense and the BM25 arm."""
    if mode not in ("hybrid", "dense", "bm25"):
        raise ValueError(f"unknown mode: {mode}")
    return mode != "bm25", mode != "dense"


def retrieve(mode: str, dense: DataFrame | None, lexical: DataFrame | None, top_k: int = 4, score: Callable[[DataFrame], DataFrame] | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """The hits of a mode (hybrid, dense or bm25), reranked to top_k by score(hits) if given, else cut.
    An arm the mode doesn't need may be None."""
    if all(arms_of(mode)):
        hits = reciprocal_rank_fusion(dense, lexical, candidates, candidates=candidates)
    else:
        hits = single_arm(dense if mode == "dense" else lexical, candidates, mode == "dense")
    return score(hits) if score else hits.where(F.col("rank") < top_k)


def context_blocks(hits: DataFrame, query: str, rank: str, source: str, body: str, *more: Column) -> DataFrame:
    """(query, context, n_blocks, *more): blocks '[i] source: ...' numbered from 1 in rank order; more are
    aggregates of a query's hits."""
    block = F.concat(F.lit("["), (F.col(rank) + 1).cast("string"), F.lit("] source: "), F.coalesce(source, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b"))))  # at most top-k entries
    return hits.groupBy(query).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), BLOCK_GAP).alias("context"), F.count("*").cast("int").alias("n_blocks"), *more)


def verified(answers: DataFrame, text: str, n_blocks: str) -> DataFrame:
    """answers with citations, valid, invalid, abstained and grounded."""
    n = F.col(n_blocks).cast("bigint")
    cited = answers.withColumn("citations", F.coalesce(citations(F.col(text)), F.array().cast("array<bigint>")))
    inside = lambda x: (x >= 1) & (x <= n)
    return (
        cited.withColumn("valid", F.filter("citations", inside))
        .withColumn("invalid", F.filter("citations", lambda x: ~inside(x)))
        .withColumn("abstained", F.coalesce(F.col(text).startswith("NOT_FOUND"), F.lit(False)))
        .withColumn("grounded", F.col("abstained") | ((F.size("citations") > 0) & (F.size("invalid") == 0)))
    )


def cited_sources(contexts: Column, valid: Column) -> Column:
    """The contexts (structs with n) whose number is among valid."""
    return F.filter(contexts, lambda c: F.array_contains(valid, c["n"].cast("bigint")))
