"""Query rewriting and routing. Models are seams: columns with their raw output come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import clean_list

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
CATEGORIES = ("lookup", "conceptual", "comparison", "unanswerable")
# Category, retrieval, hyde, multi_query, top_k.
STRATEGIES = [
    ("lookup", "bm25-weighted hybrid", False, False, 3),
    ("conceptual", "dense-weighted hybrid", True, True, 6),
    ("comparison", "hybrid", False, True, 8),
    ("unanswerable", "none", False, False, 0),
]


def with_prefix(query: Column) -> Column:
    """The instruction that goes before queries only."""
    return F.concat(F.lit(QUERY_PREFIX), query)


def hyde(question: Column, hypothetical: Column) -> Column:
    """The hypothetical passage as the query, the question where there is none."""
    return F.when(F.coalesce(F.trim(hypothetical), F.lit("")) != "", hypothetical).otherwise(question)


def multi_query(question: Column, output: Column, n: int) -> Column:
    """Up to n cleaned variants, the question first where it is absent."""
    variants = F.slice(clean_list(output, 3), 1, n)
    return F.when(F.array_contains(variants, question), variants).otherwise(F.concat(F.array(question), variants))


def decompose(question: Column, output: Column) -> Column:
    """Sub-questions over five characters, else the question alone."""
    subs = clean_list(output, 5)
    return F.when(F.size(subs) > 0, subs).otherwise(F.array(question))


def route(raw: Column) -> Column:
    """The first category named in the classifier's output, in the table's order; else conceptual."""
    category = F.lit("conceptual")
    for name in reversed(CATEGORIES):
        category = F.when(F.contains(F.lower(raw), F.lit(name)), name).otherwise(category)
    return category


def rule_classifier(question: Column) -> Column:
    """The stand-in for the classifier: identifiers are lookups, comparing words comparisons."""
    return (
        F.when(question.rlike(r"\b[A-Z]{2,}\d*-\d{2,}\b|\b[A-Z]+_[A-Z_]+\b"), "lookup")
        .when(F.lower(question).rlike(r"\b(compared?|versus|vs|difference|better|or must)\b"), "comparison")
        .otherwise("conceptual")
    )


def strategies(spark) -> DataFrame:
    return spark.createDataFrame(STRATEGIES, "category string, retrieval string, hyde boolean, multi_query boolean, top_k int")


def routed(questions: DataFrame, raw: str) -> DataFrame:
    """questions with category and its strategy (a join to the four-row table)."""
    return questions.withColumn("category", route(F.col(raw))).join(F.broadcast(strategies(questions.sparkSession)), "category")


def prepare(questions: DataFrame, question: str = "question", subs: str = "sub_questions", variants: str = "variants", hypothetical: str = "hypothetical") -> DataFrame:
    """Routed questions with queries: comparisons use their sub-questions, multi_query adds variants
    without repeats, hyde appends its passage."""
    base = F.when(F.col("category") == "comparison", F.col(subs)).otherwise(F.array(question))
    more = F.when(F.col("multi_query"), F.array_distinct(F.concat(base, F.col(variants)))).otherwise(base)
    return questions.withColumn("queries", F.when(F.col("hyde"), F.concat(more, F.array(hypothetical))).otherwise(more))


def total_seconds(*timings: Column) -> Column:
    total = F.lit(0.0)
    for t in timings:
        total = total + F.coalesce(t, F.lit(0.0))
    return F.round(total, 3)


def query_union(parts: DataFrame, query: str = "query", ordinal: str = "ordinal", text: str = "text") -> DataFrame:
    """(query, text, ordinal): the first occurrence of each text per query, renumbered from 0."""
    firsts = parts.groupBy(query, text).agg(F.min(ordinal).alias("at"))
    return firsts.select(query, text, (F.row_number().over(Window.partitionBy(query).orderBy("at", text)) - 1).alias("ordinal"))
