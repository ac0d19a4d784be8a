"""Queries of the training-data problems, and SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm import cross_split, encoding, mixing, near_duplicates, percentiles, residue, splitting, vector_forest
from rookery.session import materialise

PROBABILITIES = [0.5, 0.9, 0.99]
CORPUS_TOKENIZER = "byte_bpe_50k"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """chunks by chunk_key and hits by chunk_id, whose non-null texts are equal."""
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_key").alias("key"), "text")
    hits = table(spark, d, "hits").where("text is not null").select("chunk_id", "text").dropDuplicates(["chunk_id"])
    return chunks.union(hits.select(F.lit("hits"), "chunk_id", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near copies among chunks and among hits: three words, 0.5, at least 25 words."""
    return near_duplicates.near_duplicate_pairs(_passages(spark, d), 0.5, words=3, min_words=25).select("tbl", "key_a", "key_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each passage's group of near copies: five words, 0.8."""
    return near_duplicates.near_duplicate_groups(_passages(spark, d), 0.8, words=5, min_words=5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized chunks, and whether a cut had to be forced."""
    long = table(spark, d, "chunks").where("length(text) > 1400")
    pieces = splitting.split_oversized(long, "chunk_key", "text")
    return pieces.groupBy(F.col("key").alias("chunk_key")).agg(F.when(F.bool_or(F.col("kind") == "forced"), "forced").otherwise("natural").alias("cut"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    long = table(spark, d, "chunks").where("length(text) > 1400")
    return splitting.split_oversized(long, "chunk_key", "text").withColumnRenamed("key", "chunk_key")


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized chunk whether its pieces keep the limit, cover the text, and overlap as asked.

    An overlap is 120 to 240 characters, or what a run without cuts leaves room for: the next piece
    then holds a run of more than 1,400 - 120 less that overlap.
    """
    long = table(spark, d, "chunks").where("length(text) > 1400").select("chunk_key", F.length("text").alias("n_chars"))
    along = Window.partitionBy("chunk_key").orderBy("piece")
    run = F.array_max(F.transform(F.split("text", r"[\s.!?;:,。！？、，]"), F.length))
    pieces = p2_pieces(spark, d).withColumn("shared", F.lag("end").over(along) - F.col("start")).withColumn("run", run)
    kept = (F.col("shared") >= 0) & (F.col("shared") <= 240) & ((F.col("shared") >= 120) | (F.col("run") > 1400 - 120 - F.col("shared")))
    each = pieces.groupBy("chunk_key").agg(
        (F.max(F.col("end") - F.col("start")) <= 1400).alias("within_limit"), F.min("start").alias("first"), F.max("end").alias("last"),
        F.bool_and(F.coalesce(F.col("shared") >= 0, F.lit(True))).alias("joined"), F.bool_and(F.coalesce(kept, F.lit(True))).alias("overlaps"),
    )
    return long.join(each, "chunk_key").select("chunk_key", "n_chars", "within_limit", ((F.col("first") == 0) & (F.col("last") == F.col("n_chars")) & F.col("joined")).alias("covers"), "overlaps")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, vector_forest.Decoder]:
    decoder = vector_forest.read_decoder(table(spark, d, "int8_calib"))
    return vector_forest.packed_codes(table(spark, d, "index_codes"), "chunk_id", "i8", len(decoder.lows)), decoder


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors with cosine of at least 0.9, one among the ten most similar of the other."""
    entries, decoder = _vectors(spark, d)
    near = vector_forest.similar_vectors(entries, decoder, k=10, min_cosine=0.9)
    return near.select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunk_ids of every chunk_id divisible by 50, among all rows."""
    entries, decoder = _vectors(spark, d)
    entries = materialise(entries)
    return vector_forest.search(entries, entries.where("id % 50 = 0"), decoder).select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour"), F.round("cosine", 6).alias("score"), "place")


def _user_turns() -> F.Column:
    return F.filter("messages", lambda m: F.lower(F.trim(m["role"])) == "user")["content"]


def _overlaps(spark: SparkSession, d: str, text: F.Column) -> DataFrame:
    chat = table(spark, d, "chat_examples").select("example_id", F.lower(F.trim("split")).alias("split"), F.lower(F.trim("source")).alias("source"), text.alias("text"))
    train = chat.where("split = 'train'").select(F.col("example_id").alias("key"), "text")
    held_out = chat.where("split is null or split <> 'train'").select(F.col("example_id").alias("key"), "text", "split", "source")
    qa = table(spark, d, "qa_set").select(F.col("id").alias("key"), F.col("question").alias("text"), F.lower(F.trim("split")).alias("split"), F.lower(F.trim("source")).alias("source"))
    return cross_split.cross_split_overlaps(train, held_out.union(qa), 0.65)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and an evaluation record whose first user turns overlap."""
    return _overlaps(spark, d, F.get(_user_turns(), F.lit(0))).select(F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of any user turns per split and source of the evaluation record; a pair of records counts once."""
    pairs = _overlaps(spark, d, F.explode(_user_turns())).select("train_key", "eval_key", "split", "source").distinct()
    return cross_split.overlap_report(pairs)


def _timings(spark: SparkSession, d: str) -> DataFrame:
    """(day, cell, mode, metric, value) of distinct requests; null, NaN and -1 aren't measured."""
    rows = table(spark, d, "rag_results").select(
        "request_id", F.to_date("asked_at").alias("day"), F.lower(F.trim("cell")).alias("cell"), "mode", "retrieve_ms", "generate_ms"
    ).distinct()
    stacked = rows.select("day", "cell", "mode", F.expr("stack(2, 'retrieve_ms', retrieve_ms, 'generate_ms', generate_ms) as (metric, value)"))
    return stacked.where("value >= 0 and not isnan(value)")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """p50, p90 and p99 of retrieve_ms and generate_ms by cell and mode, from daily pieces."""
    groups = ["cell", "mode", "metric"]
    pieces = percentiles.daily_pieces(_timings(spark, d), "day", groups, "value")
    return percentiles.wide(percentiles.percentiles_of_pieces(pieces, groups, PROBABILITIES), groups, PROBABILITIES)


def p5_arms(spark: SparkSession, d: str) -> DataFrame:
    """p50, p90 and p99 of p50_ms by retrieval arm, one row per run and arm counted once."""
    arm = F.regexp_replace(F.lower(F.trim("arm")), r"\s*\+\s*", " + ")
    runs = table(spark, d, "eval_runs").select("run_id", F.to_date("run_at").alias("day"), arm.alias("arm"), "p50_ms").distinct().where("p50_ms >= 0")
    pieces = percentiles.daily_pieces(runs, "day", ["arm"], "p50_ms")
    return percentiles.wide(percentiles.percentiles_of_pieces(pieces, ["arm"], PROBABILITIES), ["arm"], PROBABILITIES)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return encoding.encode_corpus(table(spark, d, "documents"), "doc_id", "text", name=CORPUS_TOKENIZER).withColumnRenamed("key", "doc_id")


def _token_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lower(F.trim("source")).alias("source"), "text")
    return materialise(encoding.count_tokens(docs, ["key", "source"], "text", name=CORPUS_TOKENIZER).withColumnRenamed("n_tokens", "size"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn for the mix, how often each, and their tokens."""
    drawn = mixing.systematic_mix(_token_sizes(spark, d), table(spark, d, "mix_targets"))
    return drawn.select(F.col("key").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual token shares of every source."""
    sizes, targets = _token_sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.systematic_mix(sizes, targets), sizes, targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with template residue, filler or a message in place of content."""
    found = residue.residue(table(spark, d, "documents"), "doc_id", "text", "source")
    return residue.without_content(found).select(F.col("id").alias("doc_id"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_pieces, p2_checks, p3_found, p3_neighbours, p4_found, p4_report, p5_percentiles, p5_arms, p6_ids, p7_mix, p7_report, p8_found)
}

_QUANTILES = ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{100 * p:g}" for p in PROBABILITIES)

ORACLES = {
    "p1_found": """
        WITH t AS (SELECT 'chunks' AS tbl, chunk_key AS key, text FROM chunks WHERE text IS NOT NULL
                   UNION ALL SELECT 'hits', chunk_id, any_value(text) FROM hits WHERE text IS NOT NULL GROUP BY chunk_id),
        w AS (SELECT tbl, key, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM t),
        g AS (SELECT tbl, key, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s FROM w WHERE len(ws) >= 25),
        e AS (SELECT tbl, key, len(s) AS n, unnest(s) AS x FROM g),
        c AS (SELECT a.tbl, a.key AS key_a, b.key AS key_b, a.n AS na, b.n AS nb, count(*) AS held FROM e a JOIN e b ON a.tbl = b.tbl AND a.x = b.x AND a.key < b.key GROUP BY ALL)
        SELECT tbl, key_a, key_b FROM c WHERE 2 * held >= na + nb - held""",
    "p1_groups": """
        WITH RECURSIVE t AS (SELECT 'chunks' AS tbl, chunk_key AS key, text FROM chunks WHERE text IS NOT NULL
                   UNION ALL SELECT 'hits', chunk_id, any_value(text) FROM hits WHERE text IS NOT NULL GROUP BY chunk_id),
        w AS (SELECT tbl, key, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM t),
        g AS (SELECT tbl, key, list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) AS s FROM w WHERE len(ws) >= 5),
        e AS (SELECT tbl, key, len(s) AS n, unnest(s) AS x FROM g),
        c AS (SELECT a.tbl, a.key AS a, b.key AS b, a.n AS na, b.n AS nb, count(*) AS held FROM e a JOIN e b ON a.tbl = b.tbl AND a.x = b.x AND a.key <> b.key GROUP BY ALL),
        p AS (SELECT tbl, a, b, held = na AND na = nb AS same FROM c WHERE 5 * held >= 4 * (na + nb - held)),
        reach(tbl, a, b) AS (SELECT tbl, key, key FROM g UNION SELECT reach.tbl, reach.a, p.b FROM reach JOIN p ON p.tbl = reach.tbl AND p.a = reach.b),
        m AS (SELECT tbl, a AS key, min(b) AS group_id FROM reach GROUP BY ALL), l AS (SELECT tbl, a AS key, count_if(same) AS same, count_if(NOT same) AS links FROM p GROUP BY ALL)
        SELECT tbl, key, tbl || ':' || group_id AS group_id, 1 + coalesce(same, 0) AS copies, coalesce(links, 0) AS links FROM m LEFT JOIN l USING (tbl, key)""",
    "p5_percentiles": f"""
        WITH r AS (SELECT DISTINCT request_id, CAST(asked_at AS DATE) AS day, lower(trim(cell)) AS cell, mode, retrieve_ms, generate_ms FROM rag_results),
        v AS (SELECT cell, mode, 'retrieve_ms' AS metric, retrieve_ms AS value FROM r UNION ALL SELECT cell, mode, 'generate_ms', generate_ms FROM r)
        SELECT cell, mode, metric, count(*) AS n, {_QUANTILES} FROM v WHERE value >= 0 AND NOT isnan(value) GROUP BY cell, mode, metric""",
    "p5_arms": f"""
        WITH r AS (SELECT DISTINCT run_id, CAST(run_at AS DATE) AS day, regexp_replace(lower(trim(arm)), '\\s*\\+\\s*', ' + ', 'g') AS arm, p50_ms AS value FROM eval_runs)
        SELECT arm, count(*) AS n, {_QUANTILES} FROM r WHERE value >= 0 AND NOT isnan(value) GROUP BY arm""",
    "p2_found": """
        SELECT chunk_key, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\\s.!?;:,。！？、，]'), lambda p: length(p))) > 1400 THEN 'forced' ELSE 'natural' END AS cut
        FROM chunks WHERE length(text) > 1400""",
    "p3_found": """
        WITH cal AS (SELECT list(min_value ORDER BY dim_idx) AS lo, list(max_value - min_value ORDER BY dim_idx) AS sp FROM int8_calib),
        u AS (SELECT chunk_id, min(i8) AS c FROM index_codes WHERE len(i8) = 64 GROUP BY chunk_id),
        d AS (SELECT chunk_id, list_transform(range(1, 65), lambda i: (c[i] + 128) / 255 * sp[i] + lo[i]) AS v FROM u, cal),
        n AS (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM d),
        s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_inner_product(a.v, b.v) AS cos FROM n a JOIN n b ON a.chunk_id <> b.chunk_id),
        r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS place FROM s WHERE cos >= 0.9)
        SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE place <= 10""",
    "p2_checks": "SELECT chunk_key, CAST(length(text) AS INT) AS n_chars, true AS within_limit, true AS covers, true AS overlaps FROM chunks WHERE length(text) > 1400",
    "p3_neighbours": """
        WITH cal AS (SELECT list(min_value ORDER BY dim_idx) AS lo, list(max_value - min_value ORDER BY dim_idx) AS sp FROM int8_calib),
        u AS (SELECT chunk_id, min(i8) AS c FROM index_codes WHERE len(i8) = 64 GROUP BY chunk_id),
        d AS (SELECT chunk_id, list_transform(range(1, 65), lambda i: (c[i] + 128) / 255 * sp[i] + lo[i]) AS v FROM u, cal),
        n AS (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM d),
        s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_inner_product(a.v, b.v) AS cos FROM n a JOIN n b ON a.chunk_id <> b.chunk_id WHERE a.chunk_id % 50 = 0)
        SELECT chunk_id, neighbour, score, place FROM (SELECT a AS chunk_id, b AS neighbour, round(cos, 6) AS score, CAST(row_number() OVER (PARTITION BY a ORDER BY round(cos, 9) DESC, b) AS INT) AS place FROM s) WHERE place <= 10""",
    "p4_report": """
        WITH c AS (SELECT example_id AS key, lower(trim(split)) AS split, lower(trim(source)) AS source, unnest(list_filter(messages, lambda m: lower(trim(m.role)) = 'user')).content AS t FROM chat_examples),
        r AS (SELECT key, split, source, coalesce(split = 'train', false) AS tr, t FROM c UNION ALL SELECT id, lower(trim(split)), lower(trim(source)), false, question FROM qa_set),
        x AS (SELECT row_number() OVER () AS turn, key, split, source, tr, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS x FROM r WHERE t IS NOT NULL),
        g AS (SELECT *, list_distinct(list_transform(range(1, length(x) - 3), lambda i: substr(x, i, 5))) AS s FROM x WHERE length(x) >= 20),
        e AS (SELECT turn, key, split, source, tr, len(s) AS k, unnest(s) AS w FROM g),
        p AS (SELECT a.turn, b.turn, a.key AS a, b.key AS b, b.split, b.source, a.k AS ka, b.k AS kb, count(*) AS held FROM e a JOIN e b ON a.w = b.w AND a.tr AND NOT b.tr GROUP BY ALL),
        o AS (SELECT DISTINCT a, b, split, source FROM p WHERE held >= 0.65 * (ka + kb - held))
        SELECT split, source, count(DISTINCT b) AS eval_records, count(DISTINCT a) AS train_records, count(*) AS pairs FROM o GROUP BY split, source""",
    "p4_found": """
        WITH c AS (SELECT example_id AS key, lower(trim(split)) AS split, list_filter(messages, lambda m: lower(trim(m.role)) = 'user')[1].content AS t FROM chat_examples),
        r AS (SELECT key, coalesce(split = 'train', false) AS tr, t FROM c UNION ALL SELECT id, false, question FROM qa_set),
        n AS (SELECT key, tr, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS x FROM r WHERE t IS NOT NULL),
        g AS (SELECT key, tr, list_distinct(list_transform(range(1, length(x) - 3), lambda i: substr(x, i, 5))) AS s FROM n WHERE length(x) >= 20),
        e AS (SELECT key, tr, len(s) AS k, unnest(s) AS w FROM g),
        p AS (SELECT a.key AS a, b.key AS b, a.k AS ka, b.k AS kb, count(*) AS held FROM e a JOIN e b ON a.w = b.w AND a.tr AND NOT b.tr GROUP BY ALL)
        SELECT least(a, b) AS key_a, greatest(a, b) AS key_b FROM p WHERE held >= 0.65 * (ka + kb - held)""",
}
