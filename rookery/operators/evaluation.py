"""Evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions import vectors as V
from rookery.functions.text import normalise_transcript, parsed_object
from rookery.operators.order_statistics import beside, medians, values_at

FIELDS = ("component", "severity", "error_code", "page_oncall", "action")


def share(condition: Column) -> Column:
    """The share of rows for which condition holds; nulls count as not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int").cast("double"))


# ---- retrieval


def retrieval_metrics(hits: DataFrame, gold: DataFrame, by: list[str], k: int, query: str = "query", source: str = "source") -> DataFrame:
    """(*by, n, recall_1, recall_3, mrr): hit rates and reciprocal ranks over each arm's first k.

    hits: (*by, query, rank from 0, source); gold: (query, golds array<string>). "Recall" is 1 if
    any gold source is among the first ranks. Questions without a hit count as 0 in every arm.
    """
    arms = hits.select(*by).distinct()
    asked = arms.join(gold.select(query, "golds"), how="inner") if by else gold.select(query, "golds")
    right = hits.where(F.col("rank") < k).join(gold.select(query, "golds"), query).where(F.array_contains("golds", F.col(source)))
    best = right.groupBy(*by, query).agg(F.min("rank").alias("best"))
    each = asked.join(best, [*by, query], "left")
    return each.groupBy(*by).agg(
        F.count("*").alias("n"), share(F.col("best") < 1).alias("recall_1"), share(F.col("best") < min(3, k)).alias("recall_3"), F.avg(F.coalesce(1 / (F.col("best") + 1), F.lit(0.0))).alias("mrr")
    )


def ann_quality(truth: DataFrame, found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row (recall, quality): mean overlap / k, and mean over queries of the retrieved items'
    mean exact similarity over that of the true ones. truth, found: (query, item); exact: (query,
    item, score) of at least the found and true pairs."""
    overlap = truth.select("query", "item").join(found.select("query", "item"), ["query", "item"]).groupBy("query").agg(F.count("*").alias("both"))
    t = truth.select("query", "item").join(exact, ["query", "item"]).groupBy("query").agg(F.avg("score").alias("t"))
    f = found.select("query", "item").join(exact, ["query", "item"]).groupBy("query").agg(F.avg("score").alias("f"))
    return t.join(f, "query", "left").join(overlap, "query", "left").agg(F.avg(F.coalesce("both", F.lit(0)) / k).alias("recall"), F.avg(F.col("f") / F.col("t")).alias("quality"))


def generation_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: fact_recall, citation_valid, gold_in_context, abstain_correct (0.0 on empty sets), p50_ms.

    rows: answerable, facts_found, abstained, citations_ok, gold_in_context (booleans), ms.
    """
    able, unable = F.col("answerable"), ~F.col("answerable")
    rate = lambda c, where: F.coalesce(F.avg(F.when(where, c.cast("int").cast("double"))), F.lit(0.0))
    rates = rows.groupBy(*by).agg(
        rate(F.col("facts_found") & ~F.col("abstained"), able).alias("fact_recall"), rate(F.col("citations_ok"), able).alias("citation_valid"), rate(F.col("gold_in_context"), able).alias("gold_in_context"),
        rate(F.col("abstained"), unable).alias("abstain_correct"),
    )
    return beside(rates, medians(rows, by, "ms", "p50_ms"), by).withColumn("p50_ms", F.coalesce("p50_ms", F.lit(0.0)))


def paradigm_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """As generation_metrics for compared paradigms, null where a set is empty; mean_calls added."""
    rates = rows.groupBy(*by).agg(
        F.avg(F.when(F.col("answerable"), (F.col("facts_found") & ~F.col("abstained")).cast("int").cast("double"))).alias("fact_recall"),
        F.avg(F.when(~F.col("answerable"), F.col("abstained").cast("int").cast("double"))).alias("abstain_rate"), F.avg("calls").alias("mean_calls"),
    )
    return beside(rates, medians(rows, by, "ms", "p50_ms"), by)


#: Characters of a context block that a judge is shown.
JUDGED_CHARS = 900


def shown_block(block: Column, most: int = JUDGED_CHARS) -> Column:
    """The beginning of a context block that a judge is shown."""
    return F.substring(block, 1, most)


def numbered_blocks(blocks: Column) -> Column:
    """The context blocks a judge is shown, numbered from 1."""
    return F.array_join(F.transform(blocks, lambda b, i: F.concat(F.lit("["), i + 1, F.lit("] "), shown_block(b))), "\n\n")


def judged(output: Column, items: str, flag: str) -> Column:
    """struct(share, n): of the objects listed under `items` in a judge's JSON the share whose flag is
    true; 0.0 of 0 where the output holds no such list."""
    listed = F.coalesce(F.try_variant_get(parsed_object(output), f"$.{items}", "array<variant>"), F.array().cast("array<variant>"))
    held = F.size(F.filter(listed, lambda x: F.coalesce(F.try_variant_get(x, f"$.{flag}", "boolean"), F.lit(False))))
    return F.struct(F.when(F.size(listed) > 0, held / F.size(listed)).otherwise(0.0).alias("share"), F.size(listed).alias("n"))


def faithfulness(output: Column) -> Column:
    """struct(share, n) of an answer's claims that the context supports."""
    return judged(output, "claims", "supported")


def unsupported_claims(output: Column) -> Column:
    """The claims without support, in order."""
    listed = F.try_variant_get(parsed_object(output), "$.claims", "array<variant>")
    bad = F.filter(listed, lambda x: ~F.coalesce(F.try_variant_get(x, "$.supported", "boolean"), F.lit(False)))
    return F.coalesce(F.transform(bad, lambda x: F.coalesce(F.try_variant_get(x, "$.claim", "string"), F.lit(""))), F.array().cast("array<string>"))


def context_precision(output: Column) -> Column:
    """struct(share, n) of the retrieved blocks that were useful."""
    return judged(output, "verdicts", "useful")


def context_recall(output: Column) -> Column:
    """struct(share, n) of the reference answer's sentences that the context holds."""
    return judged(output, "sentences", "in_context")


def answer_relevance(questions: DataFrame, generated: DataFrame, query: str, vector: str) -> DataFrame:
    """(query, relevance): the mean cosine between a question's vector and those of the questions a
    model would ask for its answer; 0.0 where it gave none. questions, generated: (query, vector)."""
    q, g = questions.select(query, F.col(vector).alias("__q")), generated.select(query, F.col(vector).alias("__g"))
    lengths = V.norm(F.col("__q")) * V.norm(F.col("__g"))
    cosine = F.when(lengths > 0, V.dot(F.col("__q"), F.col("__g")) / lengths).otherwise(0.0)
    return q.join(g, query, "left").groupBy(query).agg(F.coalesce(F.avg(cosine), F.lit(0.0)).alias("relevance"))


def ragas_ratio(verdicts: Column) -> Column:
    """The share of true verdicts, 0.0 for none."""
    return F.when(F.size(verdicts) > 0, F.size(F.filter(verdicts, lambda v: v)) / F.size(verdicts)).otherwise(0.0)


def ragas_overall(*metrics: Column) -> Column:
    """The mean of the non-null metrics, 0.0 if there is none."""
    held = F.array_compact(F.array(*metrics))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held)).otherwise(0.0)


def calibration_gap(good: Column, bad: Column, least: float = 0.5) -> Column:
    """Whether a judge tells a good answer from a bad one by at least `least`."""
    return (good - bad) >= least


# ---- structured outputs


def scored_outputs(rows: DataFrame, output: str, gold: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """rows with json_valid, schema_valid, <field>_ok and exact. A field is right if it is present and
    of equal type and value; the schema is exactly the fields."""
    got, want = parsed_object(F.col(output)), parsed_object(F.col(gold))
    span = F.regexp_extract(F.col(output), r"(?s)\{.*\}", 0)
    value = lambda v, f: F.to_json(F.try_variant_get(v, f"$.{f}", "variant"))
    out = rows.withColumn("__g", got).withColumn("__w", want)
    keys = F.array_sort(F.json_object_keys(F.when(F.col("__g").isNotNull(), span)))
    out = out.withColumn("json_valid", F.col("__g").isNotNull()).withColumn("schema_valid", F.coalesce(keys == F.array(*[F.lit(f) for f in sorted(fields)]), F.lit(False)))
    for f in fields:
        out = out.withColumn(f"{f}_ok", F.coalesce(F.col("json_valid") & F.array_contains(keys, f) & value(F.col("__g"), f).eqNullSafe(value(F.col("__w"), f)), F.lit(False)))
    exact = F.col("schema_valid")
    for f in fields:
        exact = exact & F.col(f"{f}_ok")
    return out.withColumn("exact", exact).drop("__g", "__w")


def output_scores(scored: DataFrame, fields: tuple[str, ...] = FIELDS, by: list[str] = ()) -> DataFrame:
    """Shares over all rows."""
    return scored.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("json_valid")).alias("json_valid"), share(F.col("schema_valid")).alias("schema_valid"), *[share(F.col(f"{f}_ok")).alias(f) for f in fields], share(F.col("exact")).alias("exact"))


def failures(scored: DataFrame, key: str, cap: int = 8) -> DataFrame:
    """The first `cap` rows that aren't exact, by key: a report."""
    return scored.where("not exact").orderBy(key).limit(cap)


def rule_consistent(severity: Column, page: Column) -> Column:
    """Paging exactly for SEV1 and SEV2."""
    return page.eqNullSafe(F.lit(True)) == F.coalesce(severity.isin("SEV1", "SEV2"), F.lit(False))


def class_distribution(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, value, n): rows per value; null as 'null'."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(c.cast("string"), F.lit("null")).alias("value")) for n, c in fields.items()])).alias("x")
    return rows.select(stacked).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def majority(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, majority): the most frequent value, ties by the lesser."""
    keys = by or [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy(F.desc("__n"), value)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    return counts.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*by, F.col(value).alias("majority"))


def majority_baseline(train: DataFrame, held_out: DataFrame, by: str, value: str) -> DataFrame:
    """One row (n, global_share, conditional_share): how often train's majorities are right."""
    overall = majority(train, [], value).withColumnRenamed("majority", "overall")
    each = held_out.join(majority(train, [by], value), by, "left").join(F.broadcast(overall), how="inner")
    return each.agg(F.count("*").alias("n"), share(F.col(value) == F.col("overall")).alias("global_share"), share(F.col(value) == F.col("majority")).alias("conditional_share"))


# ---- transcripts


def word_edits(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """df with ref_words and word_edits: Levenshtein distance over white-space words, any vocabulary.

    Each word becomes one character, its place among the pair's distinct words: the distance of
    the two strings is that of the words. Places pass over the surrogates. A null is empty.
    """
    words = lambda c: F.filter(F.split(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != "")
    known = F.array_distinct(F.concat("__a", "__b"))
    place = lambda w: F.array_position("__k", w) + 32
    letter = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.when(place(w) >= 0xD800, place(w) + 0x800).otherwise(place(w))), 8, "0")), "UTF-32")
    spelled = lambda c: F.array_join(F.transform(c, letter), "")
    ready = df.withColumns({"__a": words(ref), "__b": words(hyp)}).withColumn("__k", known)
    return ready.withColumns({"ref_words": F.size("__a"), "word_edits": F.levenshtein(spelled("__a"), spelled("__b"))}).drop("__a", "__b", "__k")


def transcript_scores(df: DataFrame, ref: str, hyp: str, by: list[str] = ()) -> DataFrame:
    """(*by, n, wer, cer, sentence_accuracy): corpus-level rates after normalising both sides."""
    ready = df.withColumn("__r", normalise_transcript(F.col(ref))).withColumn("__h", normalise_transcript(F.col(hyp)))
    each = word_edits(ready, "__r", "__h").withColumn("char_edits", F.levenshtein("__r", "__h")).withColumn("chars", F.length("__r"))
    return each.groupBy(*by).agg(
        F.count("*").alias("n"), (F.sum("word_edits") / F.sum("ref_words")).alias("wer"), (F.sum("char_edits") / F.sum("chars")).alias("cer"), share(F.col("__r") == F.col("__h")).alias("sentence_accuracy")
    )


def term_recall(df: DataFrame, ref: str, hyp: str, pattern: str) -> DataFrame:
    """One row (hits, terms, recall): terms of the raw reference found in the normalised hypothesis."""
    terms = F.regexp_extract_all(F.col(ref), F.lit(pattern), F.lit(0))
    hit = F.size(F.filter(terms, lambda t: F.contains(normalise_transcript(F.col(hyp)), normalise_transcript(t))))
    return df.select(hit.alias("h"), F.size(terms).alias("t")).where("t > 0").agg(F.coalesce(F.sum("h"), F.lit(0)).alias("hits"), F.coalesce(F.sum("t"), F.lit(0)).alias("terms")).withColumn("recall", F.when(F.col("terms") > 0, F.col("hits") / F.col("terms")).otherwise(0.0))


def delta_table(metrics: DataFrame, arm: str, base: str, metric: str, value: str) -> DataFrame:
    """(arm, metric, base, value, absolute, relative, forgetting): change against the base arm."""
    b = metrics.where(F.col(arm) == base).select(metric, F.col(value).alias("base"))
    change = F.col("value") - F.col("base")
    return metrics.where(F.col(arm) != base).withColumn("value", F.col(value)).join(b, metric).select(arm, metric, "base", "value", change.alias("absolute"), F.when(F.col("base") != 0, change / F.col("base")).alias("relative"), (change > 0.05).alias("forgetting"))


# ---- timings


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: list[float]) -> DataFrame:
    """(*by, n, p<percent>...): sorted[min(n-1, round_half_even(p/100*(n-1)))] of the non-null values."""
    at = lambda p: lambda n: F.least(n - 1, F.bround(F.lit(p / 100) * (n - 1)))
    return values_at(df, by, value, {f"p{p:g}": at(p) for p in percents})


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, runs, median, spread_pct): 100 * (max - min) / median, 0 for one run."""
    ok = df.where(F.col(value).isNotNull())
    ends = beside(ok.groupBy(*by).agg(F.count("*").alias("runs"), F.min(value).alias("least"), F.max(value).alias("most")), medians(ok, by, value), by)
    wide = F.when((F.col("runs") > 1) & (F.col("median") != 0), 100 * (F.col("most") - F.col("least")) / F.col("median")).otherwise(0.0)
    return ends.select(*by, "runs", "median", wide.alias("spread_pct"))


def relative_to(df: DataFrame, variant: str, value: str, base: str) -> DataFrame:
    """(variant, value, ratio): value over that of `base`, or of the first variant where base is absent."""
    ok = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc((F.col(variant) == base).cast("int")), variant)  # one row per variant
    return ok.select(variant, F.col(value).alias("value"), (F.col(value) / F.first(value).over(w)).alias("ratio"))


def linear_projection(df: DataFrame, size: str, cost: str, target: float, constant: float = 0.0, limit: float = 300.0) -> DataFrame:
    """One row: the cost at `target` from the largest measured size, plus a constant; flagged above limit."""
    top = df.agg(F.max(size).alias("measured"), F.max_by(cost, size).alias("cost"))
    total = F.col("cost") * target / F.col("measured") + constant
    return top.select("measured", "cost", total.alias("projected"), (total > limit).alias("too_slow"))


def throughput(df: DataFrame, by: list[str], ms: str) -> DataFrame:
    """(*by, n, qps_median, qps_total): 1000 / median, and calls over their summed time."""
    ok = df.where(F.col(ms) > 0)
    totals = ok.groupBy(*by).agg(F.count("*").alias("n"), F.sum(ms).alias("total"))
    return beside(totals, medians(ok, by, ms), by).select(*by, "n", (1000 / F.col("median")).alias("qps_median"), (1000 * F.col("n") / F.col("total")).alias("qps_total"))


def concurrency_sweep(calls: DataFrame, level: str, started: str, ended: str) -> DataFrame:
    """(level, n, wall_s, qps, p50_ms, p99_ms, speedup): of calls (level, start and end in seconds) that
    ran at so many at a time, the wall clock from the first start to the last end, calls a second,
    nearest-rank latencies, and calls a second over those of the least level."""
    timed = calls.where(F.col(started).isNotNull() & (F.col(ended) >= F.col(started))).withColumn("ms", (F.col(ended) - F.col(started)) * 1000)
    walls = timed.groupBy(level).agg((F.max(ended) - F.min(started)).alias("wall_s"))
    each = beside(nearest_rank(timed, [level], "ms", [50, 99]).withColumnsRenamed({"p50": "p50_ms", "p99": "p99_ms"}), walls, [level])
    each = each.withColumn("qps", F.when(F.col("wall_s") > 0, F.col("n") / F.col("wall_s")))
    base = F.first("qps").over(Window.partitionBy(F.lit(0)).orderBy(F.col(level).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one row per level
    return each.select(level, "n", "wall_s", "qps", "p50_ms", "p99_ms", (F.col("qps") / base).alias("speedup"))


def perplexity(df: DataFrame, loss: str) -> DataFrame:
    return df.agg(F.exp(F.avg(loss)).alias("perplexity"))


def size_statistics(df: DataFrame, value: str) -> DataFrame:
    """One row (least, upper_median, most): the middle one is sorted[n // 2]."""
    found = values_at(df, [], value, {"least": lambda n: F.lit(0), "upper_median": lambda n: F.floor(n / 2), "most": lambda n: n - 1})
    return found.select("least", "upper_median", "most")


def stage_accounting(stages: DataFrame, by: list[str]) -> DataFrame:
    """(*by, busy, wait, write, busy_share, ...): each share of the summed wall clock."""
    total = F.sum("busy") + F.sum("wait") + F.sum("write")
    return stages.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("busy", "wait", "write")], *[(F.sum(c) / total).alias(f"{c}_share") for c in ("busy", "wait", "write")])
