"""Bounded agent steps: action parsing, replay of recorded actions, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import citations
from rookery.session import materialise

MAX_STEPS, PER_SEARCH = 4, 3
ACTIONS = ("search", "answer", "abstain")


def parse_actions(log: DataFrame, raw: str) -> DataFrame:
    """log with action, query, answer and reason. JSON, else the span from the first { to the last };
    anything but an object with a known action is malformed, with raw_cut its first 200 characters."""
    whole = F.try_parse_json(raw)
    span = F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    value = F.when(whole.isNotNull(), whole).otherwise(span)
    obj = F.when(F.schema_of_variant(value).startswith("OBJECT"), value)
    field = lambda name: F.try_variant_get(F.col("__v"), f"$.{name}", "string")
    known = F.coalesce(field("action").isin(*ACTIONS), F.lit(False))
    return (
        log.withColumn("__v", obj)
        .withColumn("action", F.when(known, field("action")).otherwise("malformed"))
        .withColumn("query", F.when(F.col("action") == "search", F.trim(F.coalesce(field("query"), F.lit("")))))
        .withColumn("answer", F.when(F.col("action") == "answer", F.trim(F.coalesce(field("text"), F.lit("")))))
        .withColumn("reason", F.when(F.col("action") == "abstain", F.trim(F.coalesce(field("reason"), F.lit("")))))
        .withColumn("raw_cut", F.when(F.col("action") == "malformed", F.substring(raw, 1, 200)))
        .drop("__v")
    )


def replay(actions: DataFrame, found: DataFrame, question: str = "qid", max_steps: int = MAX_STEPS, per_search: int = PER_SEARCH) -> DataFrame:
    """(qid, answer, abstained, grounded, stop_reason, llm_calls, searches, n_blocks): one row per question.

    actions: (qid, step from 1, and parse_actions' columns); found: (query, chunk_id, rank) for
    lower-cased queries. Only the first max_steps count, and the first answer or abstention ends
    the run. A repeated query searches nothing; chunks already seen add no block.
    """
    steps = actions.where(F.col("step") <= max_steps)
    ends = steps.where("action in ('answer', 'abstain')").groupBy(question).agg(F.min("step").alias("end"))
    live = steps.join(ends, question, "left").where("end is null or step <= end")
    norm = F.lower("query")
    first = Window.partitionBy(question, "norm").orderBy("step")
    searches = live.where("action = 'search'").withColumn("norm", norm).withColumn("again", F.row_number().over(first)).where("again = 1")
    blocks = searches.join(found.where(F.col("rank") < per_search).select(F.col("query").alias("norm"), "chunk_id"), "norm").groupBy(question).agg(F.count_distinct("chunk_id").cast("int").alias("n_blocks"))
    counts = searches.groupBy(question).agg(F.count("*").cast("int").alias("searches"))
    calls = live.groupBy(question).agg(F.count("*").cast("int").alias("llm_calls"), F.max("end").alias("end"), F.max(F.when(F.col("step") == F.col("end"), F.struct("action", "answer", "reason"))).alias("last"))
    out = calls.join(counts, question, "left").join(blocks, question, "left").na.fill(0, ["searches", "n_blocks"])
    cited = F.coalesce(citations(F.col("last.answer")), F.array().cast("array<bigint>"))
    answered, gave_up = F.coalesce(F.col("last.action") == "answer", F.lit(False)), F.coalesce(F.col("last.action") == "abstain", F.lit(False))
    sound = (F.size(cited) > 0) & F.forall(cited, lambda x: (x >= 1) & (x <= F.col("n_blocks")))
    return out.select(
        question,
        F.when(answered, F.col("last.answer")).when(gave_up, F.concat(F.lit("NOT_FOUND: "), F.col("last.reason"))).otherwise("NOT_FOUND: step budget exhausted before an answer.").alias("answer"),
        (~answered).alias("abstained"),
        F.when(answered, sound).otherwise(True).alias("grounded"),
        F.when(answered, F.concat(F.lit("answered"), F.when(sound, "").otherwise(" (UNGROUNDED)"))).when(gave_up, "abstained").otherwise(f"budget exhausted ({max_steps} steps)").alias("stop_reason"),
        "llm_calls", "searches", "n_blocks",
    )


def trajectory(actions: DataFrame, question: str = "qid", width: int = 90) -> DataFrame:
    """(qid, trajectory): the steps as numbered lines, details cut to width."""
    detail = F.substring(F.coalesce("query", "answer", "reason", "raw_cut", F.lit("")), 1, width)
    lines = F.array_sort(F.collect_list(F.struct("step", F.concat(F.col("step").cast("string"), F.lit(". "), "action", F.lit(": "), detail).alias("line"))))  # a run has few steps
    return actions.groupBy(question).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("trajectory"))


def evidence_text(hits: DataFrame, question: str = "qid") -> DataFrame:
    """(qid, evidence): '[i] (source) body' in order of n, blank lines between."""
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), "source", F.lit(") "), "body")
    return hits.groupBy(question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("evidence"))


def evidence(actions: DataFrame, found: DataFrame, question: str = "qid", per_search: int = PER_SEARCH) -> DataFrame:
    """(qid, n, chunk_id, source, body): each question's evidence, numbered from 1 in the order found.

    A chunk keeps the number of its first sight, so numbers stay valid as evidence grows.
    """
    first = Window.partitionBy(question, "norm").orderBy("step")
    asked = actions.where("action = 'search'").select(question, "step", F.lower("query").alias("norm")).withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    seen = asked.join(found.where(F.col("rank") < per_search).withColumnRenamed("query", "norm"), "norm")
    once = seen.groupBy(question, "chunk_id").agg(F.min_by(F.struct("step", "rank", "source", "body"), F.struct("step", "rank")).alias("x"))
    order = Window.partitionBy(question).orderBy("x.step", "x.rank", "chunk_id")
    return once.select(question, F.row_number().over(order).alias("n"), "chunk_id", "x.source", "x.body")


def run(questions: DataFrame, model: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame], max_steps: int = MAX_STEPS) -> DataFrame:
    """replay()'s row for every question after at most max_steps rounds, all questions at once.

    questions: (qid, question). model takes (qid, question, evidence, remaining) and adds raw;
    search takes (query) and gives (query, chunk_id, rank, source, body). Each round's actions and
    hits are written to the shared folder, so neither is asked twice.
    """
    live, log, found = questions.select("qid", "question"), None, None
    for step in range(1, max_steps + 1):
        shown = live.withColumn("evidence", F.lit(None).cast("string")) if log is None else live.join(evidence_text(evidence(log, found)), "qid", "left")
        prompt = shown.withColumn("evidence", F.coalesce("evidence", F.lit("(no evidence gathered yet)"))).withColumn("remaining", F.lit(max_steps - step))
        acts = materialise(parse_actions(model(prompt).select("qid", F.lit(step).alias("step"), "raw"), "raw"))
        new = acts.where("action = 'search'").select(F.lower("query").alias("query")).distinct()
        hits = materialise(search(new if found is None else new.join(found.select("query").distinct(), "query", "left_anti")).select("query", "chunk_id", "rank", "source", "body"))
        log, found = (acts, hits) if log is None else (log.union(acts), found.union(hits))
        live = live.join(acts.where("action in ('answer', 'abstain')").select("qid"), "qid", "left_anti")
    return replay(log, found)
