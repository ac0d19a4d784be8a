"""Queries of the core operators over the shared tables, each with DuckDB SQL where SQL can say it.

Searches take as queries every row whose id is divisible by 50, against all rows, but those of
retriever_sweep_reranked and the service take all questions; everything else runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.functions import seams
from rookery.functions import text as X
from rookery.functions import vectors as V
from rookery.operators import access, agent, audio, chunking, dense, evaluation, fusion, graph, lexical, query_side, synth
from rookery.operators.order_statistics import medians, values_at
from rookery.plans.service import Engine, index_stats
from rookery.session import materialise, shared_dir, together
from rookery.sources.index_store import IndexStore
from rookery.streaming.incremental import chunk_shards, windowed_latency

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BUILT: dict[tuple, object] = {}


def built(spark: SparkSession, sf_dir: str, name: str, make):
    """An index over a folder of tables, built by the first query of a session that needs it and used
    by the others. It doesn't notice tables that change under the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


PAT = X.TOKEN_PATTERN

# ---------------------------------------------------------------- tokens and BM25


@query(f"""SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(greatest(1, length(text) // 4) AS INT) END AS approx_tokens, CAST(len(regexp_extract_all(lower(text), '{PAT}')) AS INT) AS n_terms,
           CAST(len(list_distinct(regexp_extract_all(lower(text), '{PAT}'))) AS INT) AS n_distinct FROM documents""")
def token_stats(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.approx_tokens(F.col("text")).alias("approx_tokens"), F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("""SELECT min(v) AS least, list_sort(list(v))[count(*) // 2 + 1] AS upper_median, max(v) AS most
          FROM (SELECT CAST(greatest(1, length(text) // 4) AS INT) AS v FROM chunks WHERE text IS NOT NULL)""")
def corpus_size_statistics(spark, d):
    return evaluation.size_statistics(table(spark, d, "chunks").select(X.approx_tokens(F.col("text")).alias("v")), "v")


@query(f"""SELECT doc, term, CAST(count(*) AS INT) AS tf FROM (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '{PAT}')) AS term FROM documents) GROUP BY ALL""")
def postings(spark, d):
    return lexical.postings(table(spark, d, "documents"), "doc_id", "text")


@query(f"""SELECT term, count(DISTINCT doc) AS df, count(*) AS cf FROM (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '{PAT}')) AS term FROM documents) GROUP BY term""")
def doc_frequency(spark, d):
    return lexical.document_frequency(lexical.postings(table(spark, d, "documents"), "doc_id", "text"))


def all_questions(spark, d) -> DataFrame:
    """(query, question) of all qa_set rows that have a question."""
    return table(spark, d, "qa_set").select(F.substring("id", 4, 20).cast("bigint").alias("query"), "question").where("question is not null")


def questions(spark, d) -> DataFrame:
    """The search queries: all_questions() whose number is divisible by 50."""
    return all_questions(spark, d).where("query % 50 = 0")


FIFTIETH_SQL = " WHERE CAST(substr(id, 4) AS BIGINT) % 50 = 0"
BM25_SQL = f"""WITH q AS (SELECT CAST(substr(id, 4) AS BIGINT) AS query, question FROM qa_set{FIFTIETH_SQL}),
d AS (SELECT chunk_key AS doc, coalesce(regexp_extract_all(lower(body), '{PAT}'), []) AS ts FROM chunks),
dl AS (SELECT doc, len(ts) AS dl FROM d),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ts) AS term FROM d) GROUP BY ALL),
r AS (SELECT term, ln((SELECT n FROM c) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM p GROUP BY term),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
a AS (SELECT query, term, count(*) AS qf FROM (SELECT query, unnest(regexp_extract_all(lower(question), '{PAT}')) AS term FROM q) GROUP BY ALL),
s AS (SELECT query, doc, sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM c)))) AS score
      FROM a JOIN p USING (term) JOIN i USING (term) JOIN dl USING (doc) GROUP BY query, doc),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) - 1 AS rank FROM s)"""


def _bm25(spark, d, k: int | None = None, ask=questions) -> DataFrame:
    """The scores, or only each question's k best with their ranks."""
    chunks = table(spark, d, "chunks")
    posted = built(spark, d, "postings", lambda: lexical.stored_index(chunks, "chunk_key", "body", True))
    asked = (chunks, "chunk_key", "body", ask(spark, d), "query", "question")
    return lexical.bm25_best(*asked, k, posted) if k else lexical.bm25_scores(*asked, posted)


@query(f"SELECT doc, CAST(dl AS INT) AS dl, term, CAST(count(*) AS INT) AS tf FROM (SELECT chunk_key AS doc, len(ts) AS dl, unnest(ts) AS term FROM (SELECT chunk_key, regexp_extract_all(lower(body), '{PAT}') AS ts FROM chunks)) GROUP BY ALL")
def lexical_index(spark, d):
    chunks = table(spark, d, "chunks")
    return lexical.unpacked(built(spark, d, "postings", lambda: lexical.stored_index(chunks, "chunk_key", "body")))


@query(BM25_SQL + " SELECT query, doc, round(score, 6) AS score FROM s")
def bm25_scores(spark, d):
    return rounded(_bm25(spark, d), "score")


@query(BM25_SQL + " SELECT query, doc, round(score, 6) AS score, rank FROM b WHERE rank < 10")
def bm25_topk(spark, d):
    return rounded(_bm25(spark, d, 10), "score")


@query(BM25_SQL + " SELECT query, doc, round(score, 6) AS score, rank FROM b WHERE rank < 50 AND score > 0")
def bm25_positive(spark, d):
    return rounded(_bm25(spark, d, 50).where("score > 0"), "score")


# ---------------------------------------------------------------- dense and codes


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.as_doubles(F.col("embedding")).alias("v"), "label")


def _asked(spark, d) -> DataFrame:
    return _vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("qv"), F.col("label").alias("qlabel"))


E_SQL = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT vec_id AS query, v AS qv, label AS qlabel FROM e WHERE vec_id % 50 = 0)"
DENSE_SQL = E_SQL + """, s AS (SELECT query, vec_id AS item, list_inner_product(v, qv) AS score, qlabel = label AS same FROM q, e),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) - 1 AS rank FROM s)"""


@query(DENSE_SQL + " SELECT query, item, round(score, 6) AS score, rank FROM b WHERE rank < 10")
def dense_topk(spark, d):
    return rounded(dense.exact_top_k(_vectors(spark, d), "vec_id", "v", _asked(spark, d), "query", "qv", 10), "score")


SELF_SQL = E_SQL + """, s AS (SELECT query, vec_id AS item, list_inner_product(v, qv) AS score FROM q, e WHERE query <> vec_id),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) - 1 AS rank FROM s)"""


@query(SELF_SQL + " SELECT query, item, round(score, 6) AS score, rank FROM b WHERE rank < 10")
def dense_self_knn(spark, d):
    return rounded(dense.exact_top_k(_vectors(spark, d), "vec_id", "v", _asked(spark, d), "query", "qv", 10, exclude_self=True), "score")


@query("""SELECT vec_id, round(list_inner_product(v, v), 6) AS squared, round(v[1], 6) AS first FROM
          (SELECT vec_id, list_transform(w, lambda x: x / CASE WHEN list_inner_product(w, w) = 0 THEN 1 ELSE sqrt(list_inner_product(w, w)) END) AS v
           FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS w FROM embeddings))""")
def l2_normalised(spark, d):
    scaled = _vectors(spark, d).select("vec_id", F.transform("v", lambda x: x * 3).alias("w"))
    return scaled.select("vec_id", V.l2_normalise(F.col("w")).alias("v")).select("vec_id", F.round(V.dot(F.col("v"), F.col("v")), 6).alias("squared"), F.round(F.col("v")[0], 6).alias("first"))


CODE_SQL = E_SQL + """, h AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN v[i] > 0 THEN CAST(1 AS HUGEINT) << (64 - CAST(i AS INT)) ELSE CAST(0 AS HUGEINT) END)) AS u FROM e),
k AS (SELECT vec_id, CAST(CASE WHEN u >= CAST(9223372036854775808 AS HUGEINT) THEN u - CAST(18446744073709551616 AS HUGEINT) ELSE u END AS BIGINT) AS code FROM h),
n AS (SELECT a.vec_id AS query, b.vec_id AS item, CAST(bit_count(xor(a.code, b.code)) AS INT) AS hamming FROM k a, k b WHERE a.vec_id % 50 = 0),
nr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hamming, item) - 1 AS rank FROM n)"""


def _codes(spark, d) -> DataFrame:
    return _vectors(spark, d).select("vec_id", V.binary_word(F.col("v")).alias("code"))


@query(CODE_SQL + " SELECT vec_id, code FROM k")
def binary_codes(spark, d):
    return _codes(spark, d)


@query(CODE_SQL + " SELECT query, item, hamming, rank FROM nr WHERE rank < 10")
def hamming_topk(spark, d):
    codes = _codes(spark, d)
    asked = codes.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("code").alias("qc"))
    return dense.hamming_top_k(codes, "vec_id", "code", asked, "query", "qc", 10)


CAL_SQL = """, x AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(v) AS x FROM e),
cal AS (SELECT dim, quantile_cont(x, 0.001) AS low, CASE WHEN quantile_cont(x, 0.999) = quantile_cont(x, 0.001) THEN 1 ELSE quantile_cont(x, 0.999) - quantile_cont(x, 0.001) END AS span FROM x GROUP BY dim),
cc AS (SELECT list(low ORDER BY dim) AS lows, list(span ORDER BY dim) AS spans FROM cal),
e8 AS (SELECT vec_id, v, list_transform(range(1, 65), lambda i: greatest(-128, least(127, round_even((v[i] - lows[i]) / spans[i] * 255, 0) - 128))) AS c, lows, spans FROM e, cc),
d8 AS (SELECT vec_id, v, c, list_transform(range(1, 65), lambda i: (c[i] + 128) / 255 * spans[i] + lows[i]) AS w FROM e8)"""


@query(E_SQL + CAL_SQL + " SELECT CAST(dim AS INT) AS dim, round(low, 6) AS low, round(span, 6) AS span FROM cal")
def int8_calibration(spark, d):
    row = dense.calibrate_int8(_vectors(spark, d), "v", "vec_id")
    return rounded(row.select(F.posexplode(F.arrays_zip("lows", "spans")).alias("dim", "p")).select("dim", F.col("p.lows").alias("low"), F.col("p.spans").alias("span")), "low", "span")


def _decoded(spark, d) -> DataFrame:
    e = dense.with_calibration(_vectors(spark, d), dense.calibrate_int8(_vectors(spark, d), "v", "vec_id"))
    c = e.withColumn("c", V.int8_encode(F.col("v"), F.col("lows"), F.col("spans")))
    return c.withColumn("w", V.int8_decode(F.col("c"), F.col("lows"), F.col("spans")))


@query(E_SQL + CAL_SQL + " SELECT vec_id, array_to_string(list_transform(c, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS codes FROM e8")
def int8_codes(spark, d):
    return _decoded(spark, d).select("vec_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("codes"))


@query(E_SQL + CAL_SQL + " SELECT round(avg(err), 6) AS mean_error, round(max(err), 6) AS max_error FROM (SELECT unnest(list_transform(range(1, 65), lambda i: abs(w[i] - v[i]))) AS err FROM d8)")
def int8_roundtrip_error(spark, d):
    gaps = _decoded(spark, d).select(F.explode(F.zip_with("w", "v", lambda a, b: F.abs(a - b))).alias("err"))
    return rounded(gaps.agg(F.avg("err").alias("mean_error"), F.max("err").alias("max_error")), "mean_error", "max_error")


CASCADE_SQL = CODE_SQL + CAL_SQL + """, cd AS (SELECT n.query, n.item, n.hamming, list_inner_product(d8.w, q.qv) AS score FROM (SELECT * FROM nr WHERE rank < 100) n JOIN d8 ON d8.vec_id = n.item JOIN q ON q.query = n.query),
cr AS (SELECT query, item, hamming, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) - 1 AS rank FROM cd)"""


def _cascade(spark, d, k: int = 10) -> DataFrame:
    codes, calibration = built(spark, d, "codes", lambda: _coded_index(spark, d))
    return dense.cascade(codes, _asked(spark, d), "query", "qv", calibration, candidates=100, k=k)


def _coded_index(spark, d) -> tuple[DataFrame, DataFrame]:
    """The embeddings' codes and their calibration, committed to an index and opened again."""
    v = _vectors(spark, d)
    store = _store(spark)
    store.commit(dense.encode_codes(v, "vec_id", "v", store.calibrate(v, "v", "vec_id")).withColumn("shard_file", F.lit("embeddings.parquet")), "hash-64", 64)
    return store.open("hash-64").select("item", "code1", "code8"), store.calibration()


@query(CODE_SQL + CAL_SQL + " SELECT vec_id AS item, code AS code1, array_to_string(list_transform(c, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS code8 FROM e8 JOIN k USING (vec_id)")
def coded_index(spark, d):
    codes, _ = built(spark, d, "codes", lambda: _coded_index(spark, d))
    return codes.select("item", "code1", F.array_join(F.transform("code8", lambda x: x.cast("string")), ",").alias("code8"))


@query(CASCADE_SQL + " SELECT query, item, hamming, round(score, 6) AS score, rank FROM cr WHERE rank < 10")
def cascade_topk(spark, d):
    return rounded(_cascade(spark, d), "score")


TRUTH_SQL = """, ts AS (SELECT query, vec_id AS item, list_inner_product(v, qv) AS score FROM q, e),
tr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) - 1 AS rank FROM ts WHERE query <> item),
qual AS (SELECT t.query, avg(t.score) AS tm, avg(f.score) AS fm, any_value(o.held) AS held FROM (SELECT * FROM tr WHERE rank < 10) t
  JOIN (SELECT g.query, avg(ts.score) AS score FROM got g JOIN ts USING (query, item) GROUP BY g.query) f USING (query)
  LEFT JOIN (SELECT g.query, count(*) AS held FROM got g JOIN tr USING (query, item) WHERE tr.rank < 10 GROUP BY g.query) o USING (query) GROUP BY t.query)
SELECT round(avg(coalesce(held, 0) / 10), 6) AS recall, round(avg(fm / tm), 6) AS quality FROM qual"""


def _quality(spark, d, found: DataFrame) -> DataFrame:
    """recall@10 and quality of found against the exact ten, the query itself left out of both."""
    v, asked = _vectors(spark, d), _asked(spark, d)
    truth = dense.exact_top_k(v, "vec_id", "v", asked, "query", "qv", 10, exclude_self=True)
    w = Window.partitionBy("query").orderBy("rank")
    kept = found.where("query <> item").withColumn("r", F.row_number().over(w)).where("r <= 10").select("query", "item")
    pairs = kept.join(truth.select("query", "item"), ["query", "item"], "full")
    exact = pairs.join(v.select(F.col("vec_id").alias("item"), "v"), "item").join(asked, "query").select("query", "item", V.dot(F.col("v"), F.col("qv")).alias("score"))
    return rounded(evaluation.ann_quality(truth, kept, exact, 10), "recall", "quality")


@query(CASCADE_SQL + ", got AS (SELECT query, item FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS r FROM cr WHERE query <> item) WHERE r <= 10)" + TRUTH_SQL)
def cascade_recall(spark, d):
    return _quality(spark, d, _cascade(spark, d, 11))


@query(CODE_SQL + ", got AS (SELECT query, item FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS r FROM nr WHERE query <> item) WHERE r <= 10)" + TRUTH_SQL)
def binary_recall(spark, d):
    codes = _codes(spark, d)
    asked = codes.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("code").alias("qc"))
    return _quality(spark, d, dense.hamming_top_k(codes, "vec_id", "code", asked, "query", "qc", 11))


_HALF_STEP = "pow(2, greatest(floor(log2(abs(x))), -14) - 10)"
HALF_SQL = E_SQL + f""", hv AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / {_HALF_STEP}, 0) * {_HALF_STEP} END) AS w FROM e),
hs AS (SELECT query, vec_id AS item, list_inner_product(w, qv) AS score FROM hv, q WHERE vec_id <> query),
got AS (SELECT query, item FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS r FROM hs) WHERE r <= 10)"""


@query(HALF_SQL + TRUTH_SQL)
def half_precision_recall(spark, d):
    halves = dense.to_half(table(spark, d, "embeddings"), "embedding").select("vec_id", V.as_doubles(F.col("half")).alias("v"))
    return _quality(spark, d, dense.exact_top_k(halves, "vec_id", "v", _asked(spark, d), "query", "qv", 11))


MRL_SQL = E_SQL + """, m AS (SELECT vec_id, list_transform(v[1:32], lambda x: x / sqrt(list_inner_product(v[1:32], v[1:32]))) AS w FROM e),
ms AS (SELECT a.vec_id AS query, b.vec_id AS item, list_inner_product(a.w, b.w) AS score FROM m a, m b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
got AS (SELECT query, item FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS r FROM ms) WHERE r <= 10)""" + TRUTH_SQL


@query(MRL_SQL)
def matryoshka_recall(spark, d):
    cut = _vectors(spark, d).select("vec_id", V.truncate(F.col("v"), 32).alias("v"))
    asked = cut.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("qv"))
    return _quality(spark, d, dense.exact_top_k(cut, "vec_id", "v", asked, "query", "qv", 10, exclude_self=True))


@query("""SELECT n AS n_vectors, 64 AS dim, round(n * 64 * 4 / 1e9, 2) AS float32_gb, round(n * 64 * 2 / 1e9, 2) AS float16_gb, round(n * 64 / 1e9, 2) AS int8_gb, round(n * 64 / 8 / 1e9, 3) AS binary_gb,
          CASE WHEN n > 0 THEN '32x' ELSE 'n/a' END AS binary_reduction FROM (SELECT count(*) AS n FROM embeddings)""")
def memory_report(spark, d):
    return dense.memory_report(spark, [(table(spark, d, "embeddings").count(), 64)])


@query("""SELECT CAST(dim AS INT) AS dim, round(n * dim * 4 / 1e9, 2) AS float32_gb, round(n * dim / 8 / 1e9, 3) AS binary_gb, CAST(CAST(round_even(768 / dim, 0) AS INT) AS VARCHAR) || 'x smaller' AS vs_full
          FROM (SELECT count(*) * 1000 AS n FROM chunks), (SELECT unnest([768, 512, 256, 128, 64]) AS dim)""")
def matryoshka_memory(spark, d):
    return dense.matryoshka_memory(spark, table(spark, d, "chunks").count() * 1000)


@query("""SELECT n AS n_chunks, n * 350 AS n_token_vectors, round(n * 128 / 8 / 1e9, 2) AS chunk_level_binary_gb, round(n * 350 * 128 * 2 / 1e9, 1) AS token_level_float16_gb,
          round(n * 350 * 128 * 2 / 8 / 1e9, 1) AS token_level_compressed_gb, '700x' AS blowup_vs_chunk_binary FROM (SELECT count(*) * 1000 AS n FROM chunks)""")
def late_interaction_storage(spark, d):
    return dense.colbert_storage(spark, table(spark, d, "chunks").count() * 1000)


def _token_vectors(spark, d) -> DataFrame:
    """Each embedding as eight token vectors of eight dimensions."""
    return _vectors(spark, d).select("vec_id", "label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.alias("i"), F.slice("v", i * 8 + 1, 8).alias("v")))).alias("t")).select("vec_id", "label", "t.i", "t.v")


def _maxsim_sides(spark, d):
    tok = _token_vectors(spark, d)
    q = tok.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("i").alias("qt"), "v")
    p = tok.select(F.col("vec_id").alias("passage"), F.col("i").alias("pt"), "v")
    pairs = _asked(spark, d).join(_vectors(spark, d), F.expr("qlabel = label and query <> vec_id")).select("query", F.col("vec_id").alias("passage"))
    return q, p, pairs


TOK_SQL = E_SQL + """, k AS (SELECT vec_id, label, unnest(range(0, 8)) AS i, v FROM e), tok AS (SELECT vec_id, label, i, v[i * 8 + 1 : i * 8 + 8] AS v FROM k),
sim AS (SELECT a.vec_id AS query, b.vec_id AS passage, a.i AS qt, b.i AS pt, round(list_inner_product(a.v, b.v), 9) AS s FROM tok a JOIN tok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""


@query(TOK_SQL + " SELECT query, passage, round(sum(best), 6) AS score FROM (SELECT query, passage, qt, max(s) AS best FROM sim GROUP BY ALL) GROUP BY query, passage")
def maxsim(spark, d):
    return rounded(dense.max_sim(*_maxsim_sides(spark, d)), "score")


@query(TOK_SQL + """, be AS (SELECT query, passage, qt, pt, s FROM (SELECT *, row_number() OVER (PARTITION BY query, passage, qt ORDER BY s DESC, pt) AS r FROM sim) WHERE r = 1)
SELECT query, passage, CAST(qt AS INT) AS qt, CAST(pt AS INT) AS pt, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, passage ORDER BY s DESC, qt) - 1 AS rank FROM be) WHERE rank < 6""")
def maxsim_explained(spark, d):
    return rounded(dense.max_sim_explained(*_maxsim_sides(spark, d)), "similarity")


@query(E_SQL + """, tok AS (SELECT label AS doc_id, vec_id * 3 AS a, vec_id * 3 + 2 AS b, v FROM e), sp AS (SELECT label AS doc_id, unnest(range(0, m + 1)) AS span_idx FROM (SELECT label, (max(vec_id) * 3 + 2) // 200 AS m FROM e GROUP BY label)),
x AS (SELECT sp.doc_id, span_idx, unnest(range(0, 64)) AS d, unnest(v) AS x FROM sp JOIN tok USING (doc_id) WHERE a < span_idx * 200 + 300 AND b > span_idx * 200),
m AS (SELECT doc_id, span_idx, list(x ORDER BY d) AS v FROM (SELECT doc_id, span_idx, d, avg(x) AS x FROM x GROUP BY ALL) GROUP BY ALL)
SELECT sp.doc_id, CAST(sp.span_idx AS INT) AS span_idx, round(coalesce(m.v[1] / sqrt(list_inner_product(m.v, m.v)), 0), 6) AS first FROM sp LEFT JOIN m USING (doc_id, span_idx)""")
def late_chunk_pool(spark, d):
    v = _vectors(spark, d)
    tok = v.select(F.col("label").alias("doc_id"), (F.col("vec_id") * 3).alias("tok_start"), (F.col("vec_id") * 3 + 2).alias("tok_end"), "v")
    spans = tok.groupBy("doc_id").agg(F.expr("max(tok_end) div 200").cast("int").alias("last")).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("span_idx")).withColumn("char_start", F.col("span_idx") * 200).withColumn("char_end", F.col("span_idx") * 200 + 300)
    return rounded(chunking.late_chunk_pool(tok, spans).select("doc_id", "span_idx", F.col("vector")[0].alias("first")), "first")


@query(E_SQL + " SELECT a.label AS \"group\", round(sum(1 - list_inner_product(a.v, b.v)) / count(*), 6) AS diversity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def diversity(spark, d):
    return rounded(dense.pairwise_diversity(_vectors(spark, d), "label", "v"), "diversity")


@query("SELECT round(avg(m), 6) AS value FROM (SELECT query_id, avg(score) AS m FROM (SELECT DISTINCT query_id, chunk_id, score FROM hits) GROUP BY query_id)")
def adherence(spark, d):
    return rounded(dense.mean_of_means(table(spark, d, "hits").select("query_id", "chunk_id", "score").distinct(), "query_id", "score"), "value")


# ---------------------------------------------------------------- fusion and retrieval


def _dense_arm(spark, d, ask=questions) -> DataFrame:
    """A question's vector is that of its number, a chunk's that of its key."""
    asked = ask(spark, d).join(_vectors(spark, d).select(F.col("vec_id").alias("query"), F.col("v").alias("qv")), "query")
    return dense.exact_top_k(_vectors(spark, d), "vec_id", "v", asked, "query", "qv", 20)


def _lexical_arm(spark, d, ask=questions) -> DataFrame:
    return _bm25(spark, d, 20, ask).where("score > 0").withColumnRenamed("doc", "item")


def _arms(spark, d, mode: str = "hybrid", ask=questions) -> tuple[DataFrame | None, DataFrame | None]:
    """The arms that a mode needs. Two are searched at the same time and stored: their fusion would else
    be planned with the partitions of the searches, far too many for so few rows."""
    if all(needs := fusion.arms_of(mode)):
        return tuple(together(spark, lambda: materialise(_dense_arm(spark, d, ask)), lambda: materialise(_lexical_arm(spark, d, ask))))
    return _dense_arm(spark, d, ask) if needs[0] else None, _lexical_arm(spark, d, ask) if needs[1] else None


ARMS_SQL = BM25_SQL + """, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ds AS (SELECT q.query, e.vec_id AS item, list_inner_product(e.v, w.v) AS score FROM q JOIN e w ON w.vec_id = q.query AND q.question IS NOT NULL, e),
da AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) - 1 AS rank FROM ds),
la AS (SELECT query, doc AS item, score, rank FROM b WHERE rank < 20 AND score > 0),
u AS (SELECT query, item, rank AS dr, NULL AS lr FROM da WHERE rank < 20 UNION ALL SELECT query, item, NULL, rank FROM la),
f AS (SELECT query, item, max(dr) AS dense_rank, max(lr) AS bm25_rank FROM u GROUP BY ALL),
fs AS (SELECT *, coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + bm25_rank), 0) AS rrf_score FROM f),
fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rrf_score, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) - 1 AS rank FROM fs)"""


@query(ARMS_SQL + " SELECT query, item, round(rrf_score, 9) AS rrf_score, dense_rank, bm25_rank, rank FROM fr WHERE rank < 10")
def rrf_fusion(spark, d):
    return rounded(fusion.reciprocal_rank_fusion(*_arms(spark, d), 10), "rrf_score", digits=9)


@query(ARMS_SQL + " SELECT query, item, round(score, 6) AS rrf_score, rank AS dense_rank, CAST(NULL AS INT) AS bm25_rank, rank FROM da WHERE rank < 10")
def dense_only(spark, d):
    return rounded(fusion.single_arm(_dense_arm(spark, d), 10, True), "rrf_score")


@query(ARMS_SQL + " SELECT query, item, round(score, 6) AS rrf_score, CAST(NULL AS INT) AS dense_rank, rank AS bm25_rank, rank FROM la WHERE rank < 10")
def bm25_only(spark, d):
    return rounded(fusion.single_arm(_lexical_arm(spark, d), 10, False), "rrf_score")


def _payload(spark, d) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("chunk_key").alias("item"), "body", "source")


@query(ARMS_SQL + " SELECT query, item, round(rrf_score, 9) AS rrf_score, rank, c.source, c.body FROM fr JOIN chunks c ON c.chunk_key = fr.item WHERE rank < 10")
def hybrid_hits(spark, d):
    top = fusion.reciprocal_rank_fusion(*_arms(spark, d), 10).select("query", "item", "rrf_score", "rank")
    return rounded(top.join(_payload(spark, d), "item"), "rrf_score", digits=9)


OVERLAP_SQL = f"""coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(q.question), '{PAT}')), regexp_extract_all(lower(c.body), '{PAT}'))) / len(list_distinct(regexp_extract_all(lower(q.question), '{PAT}'))), 0)"""


def _overlap():
    return F.coalesce(seams.overlap_score(F.col("question"), F.col("body")), F.lit(0.0))


def _reranked(spark, d, mode: str, rerank: bool, k: int = 4, arms: tuple | None = None) -> DataFrame:
    arm_d, arm_l = arms or _arms(spark, d, mode)

    def second(hits: DataFrame) -> DataFrame:
        return fusion.rerank(hits.join(_payload(spark, d), "item").join(questions(spark, d), "query"), _overlap(), k)

    hits = fusion.retrieve(mode, arm_d, arm_l, k, second if rerank else None)
    return hits if rerank else hits.join(_payload(spark, d), "item")


@query(ARMS_SQL + f""", rr AS (SELECT fr.query, fr.item, {OVERLAP_SQL} AS rerank_score FROM (SELECT * FROM fr WHERE rank < 20) fr JOIN chunks c ON c.chunk_key = fr.item JOIN q ON q.query = fr.query)
SELECT query, item, round(rerank_score, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rerank_score, 9) DESC, item) - 1 AS rank FROM rr) WHERE rank < 4""")
def rerank_topk(spark, d):
    return rounded(_reranked(spark, d, "hybrid", True).select("query", "item", "rerank_score", "rank"), "rerank_score")


def _gold(spark, d, ask) -> DataFrame:
    qa = table(spark, d, "qa_set").select(F.substring("id", 4, 20).cast("bigint").alias("query"), F.col("gold_sources").alias("golds"))
    return ask(spark, d).join(qa, "query").select("query", "golds").where("size(golds) > 0")


def _candidates(spark, d, ask, arms: tuple[DataFrame, DataFrame], scored: bool, k: int) -> DataFrame:
    """(query, item, source, dense_rank, bm25_rank, rank) of what either arm found, rank being that of their fusion: the texts
    are read once for all modes. With rerank_score if asked for, else only what is among some mode's first k."""
    full = fusion.reciprocal_rank_fusion(*arms, 2 * fusion.CANDIDATES)
    if not scored:
        return materialise(full.where((F.col("dense_rank") < k) | (F.col("bm25_rank") < k) | (F.col("rank") < k)).join(_payload(spark, d).drop("body"), "item").drop("rrf_score"))
    return materialise(full.join(ask(spark, d), "query").join(_payload(spark, d), "item").select("query", "item", "source", "dense_rank", "bm25_rank", "rank", _overlap().alias("rerank_score")))


def _sweep(spark, d, modes: list[tuple[str, bool]], k: int = 4, ask=questions) -> DataFrame:
    parts = None
    held = _candidates(spark, d, ask, _arms(spark, d, ask=ask), any(again for _, again in modes), k)
    for mode, again in modes:
        place = F.col({"dense": "dense_rank", "bm25": "bm25_rank", "hybrid": "rank"}[mode])
        hits = fusion.rerank(held.where(place < fusion.CANDIDATES), F.col("rerank_score"), k) if again else held.where(place < k).withColumn("rank", place)
        hits = hits.select(F.lit(mode + (" + rerank" if again else "")).alias("arm"), "query", "rank", "source")
        parts = hits if parts is None else parts.unionByName(hits)
    return rounded(evaluation.retrieval_metrics(parts, _gold(spark, d, ask), ["arm"], k), "recall_1", "recall_3", "mrr")


METRIC_SQL = """, g AS (SELECT q.query, s.gold_sources AS golds FROM q JOIN qa_set s ON CAST(substr(s.id, 4) AS BIGINT) = q.query WHERE q.question IS NOT NULL AND len(s.gold_sources) > 0),
best AS (SELECT arm, h.query, min(rank) AS best FROM h JOIN g USING (query) WHERE rank < 4 AND list_contains(golds, source) GROUP BY ALL)
SELECT a.arm, count(*) AS n, round(avg(CASE WHEN best < 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN best < 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(coalesce(1 / (best + 1), 0)), 6) AS mrr
FROM (SELECT DISTINCT arm FROM h) a CROSS JOIN g LEFT JOIN best b ON b.arm = a.arm AND b.query = g.query GROUP BY a.arm"""


@query(ARMS_SQL + """, h AS (SELECT 'dense' AS arm, da.query, rank, c.source FROM da JOIN chunks c ON c.chunk_key = da.item WHERE rank < 4
  UNION ALL SELECT 'bm25', la.query, rank, c.source FROM la JOIN chunks c ON c.chunk_key = la.item WHERE rank < 4
  UNION ALL SELECT 'hybrid', fr.query, rank, c.source FROM fr JOIN chunks c ON c.chunk_key = fr.item WHERE rank < 4)""" + METRIC_SQL)
def retriever_sweep(spark, d):
    return _sweep(spark, d, [("dense", False), ("bm25", False), ("hybrid", False)])


RERANK_SQL = ARMS_SQL.replace(FIFTIETH_SQL, "") + f""", cand AS (SELECT 'dense + rerank' AS arm, query, item FROM da WHERE rank < 20 UNION ALL SELECT 'bm25 + rerank', query, item FROM la UNION ALL SELECT 'hybrid + rerank', query, item FROM fr WHERE rank < 20),
rs AS (SELECT n.arm, n.query, n.item, c.source, {OVERLAP_SQL} AS rerank_score FROM cand n JOIN chunks c ON c.chunk_key = n.item JOIN q ON q.query = n.query),
h AS (SELECT arm, query, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY arm, query ORDER BY round(rerank_score, 9) DESC, item) - 1 AS rank FROM rs) WHERE rank < 4)"""


@query(RERANK_SQL + METRIC_SQL)
def retriever_sweep_reranked(spark, d):
    return _sweep(spark, d, [("dense", True), ("bm25", True), ("hybrid", True)], ask=all_questions)


@query("""WITH h AS (SELECT DISTINCT query_id, hit_rank, chunk_id, text FROM hits)
SELECT query_id, md5(string_agg('[' || (hit_rank + 1) || '] source: ' || chunk_id || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY hit_rank, chunk_id, text NULLS FIRST)) AS context, CAST(count(*) AS INT) AS n_blocks FROM h GROUP BY query_id""")
def context_blocks(spark, d):
    hits = table(spark, d, "hits").select("query_id", "hit_rank", F.col("chunk_id").cast("string").alias("source"), "text").distinct()
    return fusion.context_blocks(hits, "query_id", "hit_rank", "source", "text").withColumn("context", F.md5("context"))


CITE_SQL = r"""WITH c AS (SELECT doc_id, source, coalesce(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL))), []) AS cites, coalesce(starts_with(text, 'NOT_FOUND'), false) AS abstained FROM documents),
v AS (SELECT doc_id, source, abstained, cites, list_filter(cites, lambda x: x >= 1 AND x <= 3) AS ok FROM c)"""


def _cited(spark, d) -> DataFrame:
    return fusion.verified(table(spark, d, "documents").select("doc_id", "source", "text", F.lit(3).alias("n")), "text", "n")


@query(CITE_SQL + " SELECT doc_id, CAST(len(cites) AS INT) AS n_citations, CAST(len(ok) AS INT) AS n_valid, CAST(len(cites) - len(ok) AS INT) AS n_invalid, abstained OR (len(cites) > 0 AND len(cites) = len(ok)) AS grounded FROM v")
def citation_check(spark, d):
    return _cited(spark, d).select("doc_id", F.size("citations").alias("n_citations"), F.size("valid").alias("n_valid"), F.size("invalid").alias("n_invalid"), "grounded")


@query(CITE_SQL + " SELECT lower(trim(source)) AS source, count(*) AS n, round(avg(CASE WHEN abstained OR (len(cites) > 0 AND len(cites) = len(ok)) THEN 1.0 ELSE 0 END), 6) AS grounding_rate FROM v GROUP BY 1")
def grounding_rate(spark, d):
    return rounded(_cited(spark, d).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"), evaluation.share(F.col("grounded")).alias("grounding_rate")), "grounding_rate")


@query(CITE_SQL + " SELECT doc_id, array_to_string(list_transform(list_filter([1, 2, 3], lambda i: list_contains(ok, i)), lambda i: 'src' || i), ',') AS cited FROM v")
def cited_sources(spark, d):
    contexts = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(f"src{i}").alias("source")) for i in (1, 2, 3)])
    return _cited(spark, d).select("doc_id", F.array_join(F.transform(fusion.cited_sources(contexts, F.col("valid")), lambda c: c["source"]), ",").alias("cited"))


# ---------------------------------------------------------------- chunking


def _span_end(p: str) -> str:
    window = f"substr(text, {p} + 1101, 300)"
    tries = ", ".join(f"{p} + 1100 + nullif(length(regexp_extract({window}, '(?s)^.*{s}', 0)), 0)" for s in (r"\n\n", r"\. ", r"\n", " "))
    return f"CASE WHEN {p} + 1400 >= n THEN n ELSE coalesce({tries}, {p} + 1400) END"


SPAN_SQL = f"""WITH RECURSIVE r AS (
 SELECT doc_id, text, n, 0 AS pos, {_span_end('0')} AS e FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 60)
 UNION ALL SELECT doc_id, text, n, np AS pos, {_span_end('np')} AS e FROM (SELECT doc_id, text, n, CASE WHEN e - 240 > pos THEN e - 240 ELSE e END AS np FROM r WHERE e < n)),
sp AS (SELECT doc_id, text, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS span_idx, CAST(pos AS INT) AS char_start, CAST(e AS INT) AS char_end FROM r WHERE e - pos >= 60)"""


def _spans(spark, d) -> DataFrame:
    return chunking.chunk_spans(table(spark, d, "documents"), "doc_id", "text")


@query(SPAN_SQL + " SELECT doc_id, span_idx, char_start, char_end FROM sp")
def chunk_spans(spark, d):
    return _spans(spark, d)


@query(SPAN_SQL + " SELECT doc_id, count(*) AS n_spans, sum(char_end - char_start) AS text_chars FROM sp GROUP BY doc_id")
def chunk_counts(spark, d):
    return _spans(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("char_end") - F.col("char_start")).alias("text_chars"))


@query(SPAN_SQL + """ SELECT doc_id, any_value(n) AS n_chars, min(char_start) AS first_start, max(char_end) AS last_end, coalesce(max(gap), 0) AS widest_gap, coalesce(max(shared), 0) AS widest_overlap
FROM (SELECT *, char_start - lag(char_end) OVER w AS gap, lag(char_end) OVER w - char_start AS shared FROM sp WINDOW w AS (PARTITION BY doc_id ORDER BY span_idx)) GROUP BY doc_id""")
def chunk_coverage(spark, d):
    w = Window.partitionBy("doc_id").orderBy("span_idx")
    s = _spans(spark, d).withColumn("before", F.lag("char_end").over(w)).join(table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars")), "doc_id")
    return s.groupBy("doc_id").agg(
        F.max("n_chars").alias("n_chars"), F.min("char_start").alias("first_start"), F.max("char_end").alias("last_end"),
        F.coalesce(F.max(F.col("char_start") - F.col("before")), F.lit(0)).alias("widest_gap"), F.coalesce(F.max(F.col("before") - F.col("char_start")), F.lit(0)).alias("widest_overlap"),
    )


@query(SPAN_SQL + " SELECT doc_id, span_idx, md5(substr(text, char_start + 1, char_end - char_start)) AS digest FROM sp")
def late_text_fetch(spark, d):
    return dense.late_fetch(_spans(spark, d), table(spark, d, "documents"), ["doc_id"]).select("doc_id", "span_idx", F.md5("text").alias("digest"))


def _files(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat("stem", F.lit(".md")).alias("file"), "stem", "text")


@query()
def section_chunks(spark, d):
    return chunking.chunk_markdown(_files(spark, d), "doc_id", "file", "text")


_BLANK = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]"
_STRIP = f"'^{_BLANK}+|{_BLANK}+$', '', 'g'"
# The entry of level k is the last heading of level k or less before, if it is of level k.
SECTION_SQL = rf"""WITH l AS (SELECT doc_id, stem, x, i FROM (SELECT doc_id, stem, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, stem, regexp_split_to_array(text, '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM documents WHERE text IS NOT NULL))),
t AS (SELECT *, length(regexp_extract(x, '^(#{{1,6}}){_BLANK}+(.*)$', 1)) AS lv, regexp_replace(regexp_extract(x, '^(#{{1,6}}){_BLANK}+(.*)$', 2), {_STRIP}) AS title FROM l),
n AS (SELECT *, sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM t),
b AS (SELECT doc_id, any_value(stem) AS stem, sec, max(lv) AS lv, max(CASE WHEN lv > 0 THEN title END) AS title, regexp_replace(coalesce(string_agg(CASE WHEN lv = 0 THEN x END, chr(10) ORDER BY i), ''), {_STRIP}) AS body FROM n GROUP BY doc_id, sec),
h AS (SELECT doc_id, list({{'sec': sec, 'lv': lv, 'title': title}} ORDER BY sec) AS hs FROM b WHERE lv > 0 GROUP BY doc_id),
p AS (SELECT b.*, CASE WHEN lv = 0 THEN [] ELSE list_transform(range(1, lv), lambda k: list_filter(hs, lambda y: y.sec < b.sec AND y.lv <= k)[-1]) END AS up FROM b LEFT JOIN h USING (doc_id)),
r AS (SELECT *, [stem || '.md'] || list_filter(list_transform(up, lambda y, k: CASE WHEN y.lv = k THEN y.title ELSE '' END) || [coalesce(title, '')], lambda z: z <> '') AS crumb FROM p)"""


@query(SECTION_SQL + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INT) AS section_idx, array_to_string(crumb, ' > ') AS breadcrumb, CAST(length(body) AS INT) AS body_chars FROM r WHERE body <> ''")
def breadcrumbs(spark, d):
    docs = _files(spark, d).select("doc_id", "file")
    return chunking.sections(table(spark, d, "documents"), "doc_id", "text").join(docs, "doc_id").select("doc_id", "section_idx", X.breadcrumb(F.col("file"), F.col("headings")).alias("breadcrumb"), F.length("body").alias("body_chars"))


@query("""WITH l AS (SELECT doc_id, stem, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(trim(substr(list_filter(ls, lambda x: starts_with(x, '# '))[1], 3)), stem) AS title, array_to_string(list_transform(list_filter(ls, lambda x: starts_with(x, '## ')), lambda x: trim(substr(x, 4))), '|') AS sections, strlen(text) AS n_bytes FROM l""")
def doc_outline(spark, d):
    o = X.outline(F.col("text"), F.col("stem"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", o.alias("o")).select("doc_id", "o.title", F.array_join("o.sections", "|").alias("sections"), F.col("o.n_bytes").cast("bigint").alias("n_bytes"))


# A gap is put between chr(1) and chr(2); line ends in a gap that is marked already become chr(3), so that they aren't marked again.
SENTENCE_SQL = rf"""WITH a AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])({_BLANK}+)([A-Z"''(])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, array_to_string(list_transform(ps, lambda p, i: CASE WHEN i = 1 THEN p ELSE translate(split_part(p, chr(2), 1), chr(10), chr(3)) || substr(p, length(split_part(p, chr(2), 1)) + 1) END), chr(1)) AS m FROM a),
c AS (SELECT doc_id, string_split(regexp_replace(m, '(\n\n+)', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS ps FROM b),
x AS (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM c),
y AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 0 ELSE length(split_part(p, chr(2), 1)) END AS gap, CASE WHEN i = 1 THEN p ELSE substr(p, length(split_part(p, chr(2), 1)) + 2) END AS s FROM x),
z AS (SELECT *, sum(gap + length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM y),
s AS (SELECT * FROM z WHERE length(regexp_replace(s, '{_BLANK}+', '', 'g')) > 0)"""


@query(SENTENCE_SQL + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS sentence_idx, CAST(upto - length(s) AS INT) AS char_start, CAST(upto AS INT) AS char_end FROM s")
def sentences(spark, d):
    return chunking.sentences(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "sentence_idx", "char_start", "char_end")


@query()
def semantic_chunks(spark, d):
    return chunking.semantic_chunks(table(spark, d, "documents"), "doc_id", "text", seams.hash_embed)


@query("SELECT chunk_key, source || chr(10) || chr(10) || body AS prefixed FROM chunks WHERE source IS NOT NULL AND body IS NOT NULL")
def context_prefix(spark, d):
    return table(spark, d, "chunks").where("source is not null and body is not null").select("chunk_key", X.with_context(F.col("source"), F.col("body")).alias("prefixed"))


@query("SELECT id, coalesce(len(must_contain) = 0 OR (question IS NOT NULL AND len(list_filter(must_contain, lambda m: NOT contains(lower(question), lower(m)))) = 0), false) AS all_found FROM qa_set")
def must_contain_probe(spark, d):
    return table(spark, d, "qa_set").select("id", F.coalesce(X.contains_all(F.col("question"), F.col("must_contain")), F.lit(False)).alias("all_found"))


@query(r"""SELECT name, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower(trim(name)), '''s(\s|$)', '\1', 'g'), '[`"'']', '', 'g'), '_', ' '), '\s+', ' ', 'g'), '\b([a-z]{2,4}) (\d{3})\b', '\1-\2', 'g'), '\bsev (\d)\b', 'sev\1', 'g') AS entity,
regexp_replace(lower(trim(name)), '\s+', '_', 'g') AS relation FROM (SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier UNION SELECT 'SEV ' || (s_suppkey % 4) || ' TLM 33' || (s_suppkey % 10) || ' owner''s `Lane_' || s_suppkey || '`' FROM supplier)""")
def entity_normalize(spark, d):
    made = table(spark, d, "supplier").select(F.expr("concat('SEV ', s_suppkey % 4, ' TLM 33', s_suppkey % 10, ' owner\\'s `Lane_', s_suppkey, '`')").alias("name"))
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).union(table(spark, d, "supplier").select("s_name")).union(made).distinct()
    return names.select("name", X.normalise_entity(F.col("name")).alias("entity"), X.normalise_relation(F.col("name")).alias("relation"))


@query(r"""SELECT id, array_to_string(list_filter(list_transform(string_split('1. ' || question || chr(10) || '- short' || chr(10) || '* ok', chr(10)), lambda x: trim(regexp_replace(x, '^\s*[-*\d.)]+\s*', ''))), lambda x: length(x) > 3), '|') AS cleaned FROM qa_set WHERE question IS NOT NULL""")
def list_cleaning(spark, d):
    out = F.concat(F.lit("1. "), "question", F.lit("\n- short\n* ok"))
    return table(spark, d, "qa_set").where("question is not null").select("id", F.array_join(X.clean_list(out, 3), "|").alias("cleaned"))


@query("SELECT s_suppkey, replace(replace('Unit {unit} of {place}', '{unit}', s_name), '{place}', n_name) AS written, lower(replace(replace('Unit {unit} of {place}', '{unit}', s_name), '{place}', n_name)) AS spoken FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def template_filling(spark, d):
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    written = X.fill_template(F.lit("Unit {unit} of {place}"), {"unit": F.col("s_name"), "place": F.col("n_name")})
    return joined.select("s_suppkey", written.alias("written"), F.lower(written).alias("spoken"))


@query("""SELECT id, concat_ws(', ', CASE WHEN contains(question, 'corvid-charge') THEN 'corvid-charge = "corvid charge"' END, CASE WHEN contains(question, 'ms') THEN 'ms = "milliseconds"' END) AS hints FROM qa_set WHERE question IS NOT NULL""")
def pronunciation_hints(spark, d):
    return table(spark, d, "qa_set").where("question is not null").select("id", X.hints(F.col("question"), {"corvid-charge": "corvid charge", "ms": "milliseconds"}).alias("hints"))


# ---------------------------------------------------------------- graph and agent


def _edges(spark, d) -> DataFrame:
    nation, region, customer, supplier = (table(spark, d, n) for n in ("nation", "region", "customer", "supplier"))
    c = customer.join(nation, F.expr("c_nationkey = n_nationkey")).select(F.col("c_name").alias("s"), F.lit("buys_in").alias("r"), F.col("n_name").alias("o"), F.lit("customer::001").alias("source"))
    s = supplier.join(nation, F.expr("s_nationkey = n_nationkey")).select("s_name", F.lit("ships_from"), "n_name", F.lit("supplier::001"))
    n = nation.join(region, F.expr("n_regionkey = r_regionkey")).select("n_name", F.lit("part_of"), "r_name", F.lit("nation::001"))
    return graph.build(c.union(s).union(n))


EDGE_SQL = """WITH t AS (SELECT c_name AS s, 'buys_in' AS r, n_name AS o, 'customer::001' AS source FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT s_name, 'ships_from', n_name, 'supplier::001' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 'part_of', r_name, 'nation::001' FROM nation JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT replace(lower(trim(s)), '_', ' ') AS s, r, replace(lower(trim(o)), '_', ' ') AS o, source FROM t), nodes AS (SELECT s AS node FROM g UNION SELECT o FROM g)"""


@query(EDGE_SQL + " SELECT s, r, o, source FROM g")
def graph_triples(spark, d):
    return _edges(spark, d)


def _graph_questions(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("query"), F.concat(F.lit("Which suppliers ship from "), "n_name", F.lit("'s docks?")).alias("question"))


LINK_SQL = EDGE_SQL + """, gq AS (SELECT CAST(n_nationkey AS BIGINT) AS query, regexp_extract_all(replace(lower('which suppliers ship from ' || n_name || ' docks?'), '_', ' '), '[a-z0-9.-]+') AS w FROM nation),
gr AS (SELECT DISTINCT query, array_to_string(w[i : i + n - 1], ' ') AS node FROM (SELECT query, w, unnest(range(1, len(w) + 1)) AS i FROM gq), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE i + n - 1 <= len(w)),
hit AS (SELECT query, node FROM gr WHERE node IN (SELECT node FROM nodes) AND NOT (NOT contains(node, ' ') AND (length(node) < 3 OR node IN ('the', 'which', 'from')))),
li AS (SELECT query, node FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.query = h.query AND o.node <> h.node AND contains(o.node, h.node)))"""


@query(LINK_SQL + " SELECT query, node FROM li")
def graph_link(spark, d):
    return graph.link_entities(_graph_questions(spark, d), "query", "question", _edges(spark, d))


WALK_SQL = LINK_SQL + """, h1 AS (SELECT li.query, li.node AS start, g.s, g.r, g.o, min(g.source) AS source, 1 AS hops FROM li JOIN g ON g.s = li.node OR g.o = li.node GROUP BY ALL),
full1 AS (SELECT query, start FROM h1 GROUP BY ALL HAVING count(*) >= 30),
f1 AS (SELECT DISTINCT query, start, node FROM (SELECT query, start, s AS node FROM h1 UNION ALL SELECT query, start, o FROM h1) WHERE node <> start),
h2 AS (SELECT f1.query, f1.start, g.s, g.r, g.o, min(g.source) AS source, 2 AS hops FROM f1 JOIN g ON g.s = f1.node OR g.o = f1.node ANTI JOIN full1 ON full1.query = f1.query AND full1.start = f1.start GROUP BY ALL),
al AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.query = h2.query AND h1.start = h2.start AND h1.s = h2.s AND h1.r = h2.r AND h1.o = h2.o)),
wk AS (SELECT query, start, s, r, o, source, hops FROM (SELECT *, row_number() OVER (PARTITION BY query, start ORDER BY hops, s, r, o, source) AS "at" FROM al) WHERE "at" <= 30)"""


def _walked(spark, d) -> DataFrame:
    edges = _edges(spark, d)
    return graph.walk(graph.link_entities(_graph_questions(spark, d), "query", "question", edges), edges)


@query(WALK_SQL.replace("FROM f1 JOIN g ON g.s = f1.node OR g.o = f1.node ANTI JOIN full1 ON full1.query = f1.query AND full1.start = f1.start GROUP BY ALL", "FROM f1 JOIN g ON g.s = f1.node OR g.o = f1.node WHERE NOT EXISTS (SELECT 1 FROM full1 WHERE full1.query = f1.query AND full1.start = f1.start) GROUP BY ALL") + " SELECT query, start, s, r, o, source, hops FROM wk")
def k_hop_walk(spark, d):
    return _walked(spark, d)


WALK_SQL = ORACLES["k_hop_walk"].rsplit(" SELECT query, start", 1)[0]


@query(WALK_SQL + """, fa AS (SELECT query, s || ' --' || r || '--> ' || o AS fact, source, hops, row_number() OVER (PARTITION BY query ORDER BY hops, start, s, r, o, source) AS "at" FROM wk)
SELECT query, fact, source, hops, "at" FROM fa WHERE "at" <= 24""")
def graph_retrieve(spark, d):
    return graph.retrieve_facts(_walked(spark, d))


@query(WALK_SQL + """, fa AS (SELECT query, s || ' --' || r || '--> ' || o AS fact, source, row_number() OVER (PARTITION BY query ORDER BY hops, start, s, r, o, source) AS "at" FROM wk),
fb AS (SELECT * FROM fa WHERE "at" <= 24), n AS (SELECT query, source, count(*) AS facts, min("at") AS first FROM fb GROUP BY ALL),
tc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY facts DESC, first) AS r FROM n) WHERE r <= 4), b AS (SELECT source, CAST(count(*) AS VARCHAR) AS body FROM g GROUP BY source)
SELECT query, 1 AS n, string_agg(fact, chr(10) ORDER BY "at") AS body FROM fb GROUP BY query UNION ALL SELECT query, row_number() OVER (PARTITION BY query ORDER BY facts DESC, source) + 1, body FROM tc JOIN b USING (source)""")
def graph_chunks(spark, d):
    facts = graph.retrieve_facts(_walked(spark, d))
    chunks = _edges(spark, d).groupBy(F.col("source").alias("chunk")).agg(F.count("*").cast("string").alias("body"))
    return graph.blocks(facts, graph.retrieve_chunks(facts, chunks, "chunk", "body"))


@query(EDGE_SQL + """, l AS (SELECT s AS a, o AS b FROM g UNION SELECT o, s FROM g),
reach AS (WITH RECURSIVE w AS (SELECT node AS a, node AS b FROM nodes UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b) SELECT * FROM w),
c AS (SELECT a, min(b) AS component FROM reach GROUP BY a), z AS (SELECT component, count(*) AS n FROM c GROUP BY component)
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM g) AS edges, (SELECT count(*) FROM g) AS triples, (SELECT count(*) FROM z) AS components, (SELECT max(n) FROM z) AS largest_component""")
def graph_stats(spark, d):
    return graph.stats(_edges(spark, d))


@query("""SELECT replace(lower(trim(n_name)), '_', ' ') AS s, 'part_of' AS r, replace(lower(trim(r_name)), '_', ' ') AS o, 'n::' || n_nationkey AS source FROM nation JOIN region ON n_regionkey = r_regionkey""")
def graph_extract(spark, d):
    made = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).select(
        F.concat(F.lit("n::"), "n_nationkey").alias("source"), F.concat(F.lit('Here: {"triples": [{"s": "'), "n_name", F.lit('", "r": "Part Of", "o": "'), "r_name", F.lit('"}, 7, {"s": "", "r": "x", "o": "y"}]} done')).alias("output")
    )
    return graph.extracted_triples(made, "output", "source")


RAW_ACTION = """CASE n_hits % 4 WHEN 0 THEN concat('{"action": "search", "query": "', question, '"}') WHEN 1 THEN 'so: {"action": "answer", "text": "see [1] and [2]"} ok'
 WHEN 2 THEN '{"action": "abstain", "reason": "nothing found"}' ELSE 'no json here' END"""


def _action_log(spark, d) -> DataFrame:
    rows = table(spark, d, "rag_results").where("question is not null").select("request_id", "question", "n_hits").distinct()
    return rows.select("request_id", F.expr("cast(request_id div 5 as bigint)").alias("qid"), F.expr("cast(request_id % 5 + 1 as int)").alias("step"), F.expr(RAW_ACTION).alias("raw"))


@query(f"""WITH r AS (SELECT DISTINCT request_id, question, n_hits FROM rag_results WHERE question IS NOT NULL), w AS (SELECT request_id, {RAW_ACTION} AS raw FROM r),
j AS (SELECT request_id, raw, regexp_extract(raw, '(?s)\\{{.*\\}}', 0) AS span FROM w), a AS (SELECT request_id, CASE WHEN json_valid(span) THEN json_extract_string(span, '$.action') END AS action, span FROM j)
SELECT request_id, coalesce(action, 'malformed') AS action, CASE WHEN action = 'search' THEN trim(json_extract_string(span, '$.query')) END AS query FROM a""")
def action_parse(spark, d):
    return agent.parse_actions(_action_log(spark, d), "raw").select("request_id", "action", "query")


ACTION_SQL = f"""WITH r AS (SELECT DISTINCT request_id, question, n_hits FROM rag_results WHERE question IS NOT NULL), w AS (SELECT request_id // 5 AS qid, CAST(request_id % 5 + 1 AS INT) AS step, {RAW_ACTION} AS raw FROM r),
j AS (SELECT *, regexp_extract(raw, '(?s)\\{{.*\\}}', 0) AS span FROM w), k AS (SELECT *, coalesce(CASE WHEN json_valid(span) THEN json_extract_string(span, '$.action') END, 'malformed') AS action FROM j),
ac AS (SELECT qid, step, action, CASE action WHEN 'search' THEN trim(json_extract_string(span, '$.query')) WHEN 'answer' THEN trim(json_extract_string(span, '$.text')) WHEN 'abstain' THEN trim(json_extract_string(span, '$.reason')) ELSE substr(raw, 1, 200) END AS detail FROM k)"""


@query(ACTION_SQL + """, en AS (SELECT qid, min(step) AS stop FROM ac WHERE step <= 4 AND action IN ('answer', 'abstain') GROUP BY qid), li AS (SELECT ac.*, stop FROM ac LEFT JOIN en USING (qid) WHERE step <= 4 AND (stop IS NULL OR step <= stop)),
se AS (SELECT DISTINCT qid, lower(detail) AS q FROM li WHERE action = 'search'), bl AS (SELECT qid, (length(q) * 31 + unnest(range(0, 3))) % 97 AS chunk FROM se),
c AS (SELECT qid, count(*) AS llm_calls, max(CASE WHEN step = stop THEN action END) AS last, max(CASE WHEN step = stop THEN detail END) AS said FROM li GROUP BY qid),
x AS (SELECT c.*, coalesce(s.n, 0) AS searches, coalesce(b.n, 0) AS n_blocks FROM c LEFT JOIN (SELECT qid, count(*) AS n FROM se GROUP BY qid) s USING (qid) LEFT JOIN (SELECT qid, count(DISTINCT chunk) AS n FROM bl GROUP BY qid) b USING (qid))
SELECT qid, CASE last WHEN 'answer' THEN said WHEN 'abstain' THEN 'NOT_FOUND: ' || said ELSE 'NOT_FOUND: step budget exhausted before an answer.' END AS answer, coalesce(last, '') <> 'answer' AS abstained, coalesce(last, '') <> 'answer' OR n_blocks >= 2 AS grounded,
CASE last WHEN 'answer' THEN CASE WHEN n_blocks >= 2 THEN 'answered' ELSE 'answered (UNGROUNDED)' END WHEN 'abstain' THEN 'abstained' ELSE 'budget exhausted (4 steps)' END AS stop_reason, CAST(llm_calls AS INT) AS llm_calls, CAST(searches AS INT) AS searches, CAST(n_blocks AS INT) AS n_blocks FROM x""")
def agent_replay(spark, d):
    actions = agent.parse_actions(_action_log(spark, d), "raw")
    found = actions.where("action = 'search'").select(F.lower("query").alias("query")).distinct()
    found = found.select("query", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), ((F.length("query") * 31 + i) % 97).alias("chunk_id")) for i in range(3)])).alias("h")).select("query", "h.rank", "h.chunk_id")
    return agent.replay(actions, found)


@query(ACTION_SQL + " SELECT qid, string_agg(step || '. ' || action || ': ' || substr(coalesce(detail, ''), 1, 90), chr(10) ORDER BY step, step || '. ' || action || ': ' || substr(coalesce(detail, ''), 1, 90)) AS trajectory FROM ac GROUP BY qid")
def trajectory(spark, d):
    return agent.trajectory(agent.parse_actions(_action_log(spark, d), "raw"))


@query("""WITH h AS (SELECT DISTINCT query_id, hit_rank + 1 AS n, chunk_id, coalesce(text, '') AS body FROM hits)
SELECT query_id, md5(string_agg('[' || n || '] (' || chunk_id || ') ' || body, chr(10) || chr(10) ORDER BY n, '[' || n || '] (' || chunk_id || ') ' || body)) AS evidence FROM h GROUP BY query_id""")
def agent_evidence(spark, d):
    hits = table(spark, d, "hits").select("query_id", (F.col("hit_rank") + 1).alias("n"), F.col("chunk_id").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("body")).distinct()
    return agent.evidence_text(hits, "query_id").withColumn("evidence", F.md5("evidence"))


@query(E_SQL + """, nv AS (SELECT count(*) AS n FROM e), sz AS (SELECT n // unnest([5, 2, 1]) AS size FROM nv), pl AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM e), s AS (SELECT size, query, vec_id AS item, row_number() OVER (PARTITION BY size, query ORDER BY round(list_inner_product(v, qv), 9) DESC, vec_id) - 1 AS rank FROM sz, q, e JOIN pl USING (vec_id) WHERE place < size),
m AS (SELECT size, query, bool_or(label = 1) AS one, bool_or(label = 2) AS two FROM s JOIN e ON e.vec_id = item WHERE rank < 4 GROUP BY ALL)
SELECT size, count(*) AS n, count_if(one AND two) AS both_hops, count_if(one <> two) AS one_hop, count_if(NOT one AND NOT two) AS neither FROM m GROUP BY size""")
def co_retrieval(spark, d):
    v, asked = _vectors(spark, d), _asked(spark, d)
    n, parts = v.count(), None
    sizes = [n // 5, n // 2, n]  # a fifth, a half, and the whole table
    bounds = values_at(v, [], "vec_id", {str(s): (lambda s: lambda _: F.lit(max(0, s - 1)))(s) for s in sizes}).first()
    for size in sizes:
        top = dense.exact_top_k(v.where(F.col("vec_id") <= bounds[str(size)]), "vec_id", "v", asked, "query", "qv", 4).join(v.select(F.col("vec_id").alias("item"), "label"), "item")
        each = top.groupBy("query").agg(F.bool_or(F.col("label") == 1).alias("one"), F.bool_or(F.col("label") == 2).alias("two")).withColumn("size", F.lit(size).cast("long"))
        parts = each if parts is None else parts.unionByName(each)
    return parts.groupBy("size").agg(F.count("*").alias("n"), F.count_if(F.col("one") & F.col("two")).alias("both_hops"), F.count_if(F.col("one") != F.col("two")).alias("one_hop"), F.count_if(~F.col("one") & ~F.col("two")).alias("neither"))


# ---------------------------------------------------------------- query side


@query(r"""WITH c AS (SELECT id, CASE WHEN regexp_matches(question, '\b[A-Z]{2,}\d*-\d{2,}\b|\b[A-Z]+_[A-Z_]+\b') THEN 'lookup' WHEN regexp_matches(lower(question), '\b(compared?|versus|vs|difference|better|or must)\b') THEN 'comparison' ELSE 'conceptual' END AS category FROM qa_set WHERE question IS NOT NULL)
SELECT id, category, CASE category WHEN 'lookup' THEN 'bm25-weighted hybrid' WHEN 'comparison' THEN 'hybrid' ELSE 'dense-weighted hybrid' END AS retrieval, CAST(CASE category WHEN 'lookup' THEN 3 WHEN 'comparison' THEN 8 ELSE 6 END AS INT) AS top_k FROM c""")
def route_strategy(spark, d):
    qa = table(spark, d, "qa_set").where("question is not null").select("id", query_side.rule_classifier(F.col("question")).alias("raw"))
    return query_side.routed(qa, "raw").select("id", "category", "retrieval", "top_k")


@query("""WITH p AS (SELECT id AS query, question AS text, 0 AS ordinal FROM qa_set WHERE question IS NOT NULL UNION ALL SELECT id, unnest(must_contain || [question]), unnest(range(1, len(must_contain) + 2)) FROM qa_set WHERE question IS NOT NULL AND must_contain IS NOT NULL),
f AS (SELECT query, text, min(ordinal) AS first FROM p GROUP BY ALL) SELECT query, text, row_number() OVER (PARTITION BY query ORDER BY first, text) - 1 AS ordinal FROM f""")
def multi_query_union(spark, d):
    qa = table(spark, d, "qa_set").where("question is not null")
    more = qa.where("must_contain is not null").select(F.col("id").alias("query"), F.posexplode(F.concat("must_contain", F.array("question"))).alias("i", "text")).select("query", "text", (F.col("i") + 1).alias("ordinal"))
    return query_side.query_union(qa.select(F.col("id").alias("query"), F.col("question").alias("text"), F.lit(0).alias("ordinal")).union(more))


@query(r"""WITH c AS (SELECT id, question, CASE WHEN regexp_matches(question, '\b[A-Z]{2,}\d*-\d{2,}\b|\b[A-Z]+_[A-Z_]+\b') THEN 'lookup' WHEN regexp_matches(lower(question), '\b(compared?|versus|vs|difference|better|or must)\b') THEN 'comparison' ELSE 'conceptual' END AS category FROM qa_set WHERE question IS NOT NULL),
l AS (SELECT *, list_transform(string_split('1. ' || lower(question) || chr(10) || '2. ' || question, chr(10)), lambda x: trim(regexp_replace(x, '^\s*[-*\d.)]+\s*', ''))) AS lines FROM c),
s AS (SELECT *, list_filter(lines, lambda x: length(x) > 5) AS subs, list_filter(lines, lambda x: length(x) > 3)[1:3] AS vars FROM l),
v AS (SELECT *, CASE WHEN list_contains(vars, question) THEN vars ELSE [question] || vars END AS variants, CASE WHEN len(subs) > 0 THEN subs ELSE [question] END AS parts FROM s),
b AS (SELECT *, CASE category WHEN 'comparison' THEN parts || variants WHEN 'conceptual' THEN [question] || variants ELSE [question] END AS x FROM v),
f AS (SELECT *, list_filter(x, lambda y, i: NOT list_contains(x[1 : i - 1], y)) AS qs FROM b)
SELECT id, category, array_to_string(CASE WHEN category = 'conceptual' THEN qs || ['It is known that ' || question] ELSE qs END, '|') AS queries FROM f""")
def prepared_queries(spark, d):
    qa = table(spark, d, "qa_set").where("question is not null").select("id", "question", query_side.rule_classifier(F.col("question")).alias("raw"))
    listed = F.concat(F.lit("1. "), F.lower("question"), F.lit("\n2. "), "question")
    ready = query_side.routed(qa, "raw").withColumn("sub_questions", query_side.decompose(F.col("question"), listed)).withColumn("variants", query_side.multi_query(F.col("question"), listed, 3)).withColumn("hypothetical", query_side.hyde(F.col("question"), F.concat(F.lit("It is known that "), "question")))
    return query_side.prepare(ready).select("id", "category", F.array_join("queries", "|").alias("queries"))


@query("SELECT id, 'Represent this sentence for searching relevant passages: ' || question AS prefixed FROM qa_set WHERE question IS NOT NULL")
def query_prefix(spark, d):
    return table(spark, d, "qa_set").where("question is not null").select("id", query_side.with_prefix(F.col("question")).alias("prefixed"))


# ---------------------------------------------------------------- duplicates, leakage, structured outputs


@query("SELECT count(*) AS total, count(DISTINCT text) AS distinct_texts, count(*) - count(DISTINCT text) AS duplicates FROM documents WHERE text IS NOT NULL")
def exact_dups(spark, d):
    return synth.duplicate_statistics(table(spark, d, "documents"), "text")


CHAT_SQL = """WITH ch AS (SELECT example_id, lower(trim(split)) AS split, list_filter(messages, lambda m: lower(trim(m.role)) = 'user')[1].content AS said, list_filter(messages, lambda m: lower(trim(m.role)) = 'assistant')[1].content AS gold, list_filter(messages, lambda m: lower(trim(m.role)) = 'assistant')[-1].content AS output FROM chat_examples)"""


def _chat(spark, d) -> DataFrame:
    turn = lambda role: F.filter("messages", lambda m: F.lower(F.trim(m["role"])) == role)
    return table(spark, d, "chat_examples").select(
        "example_id", F.lower(F.trim("split")).alias("split"), F.get(turn("user"), F.lit(0))["content"].alias("said"), F.get(turn("assistant"), F.lit(0))["content"].alias("gold"), F.try_element_at(turn("assistant"), F.lit(-1))["content"].alias("output")
    )


TURN_SQL = "WITH ch AS (SELECT example_id, lower(trim(split)) AS split, unnest(list_filter(messages, lambda m: lower(trim(m.role)) = 'user')).content AS said FROM chat_examples)"


def _turns(spark, d) -> DataFrame:
    """Every user turn of every example."""
    users = F.filter("messages", lambda m: F.lower(F.trim(m["role"])) == "user")
    return table(spark, d, "chat_examples").select("example_id", F.lower(F.trim("split")).alias("split"), F.explode(users).alias("m")).select("example_id", "split", F.col("m.content").alias("said"))


@query(TURN_SQL + ", tr AS (SELECT DISTINCT said FROM ch WHERE split = 'train' AND said IS NOT NULL) SELECT split, count(*) AS n, round(avg(CASE WHEN said IN (SELECT said FROM tr) THEN 1.0 ELSE 0 END), 6) AS leaked_share FROM ch WHERE split <> 'train' GROUP BY split")
def leakage_share(spark, d):
    ch = _turns(spark, d)
    return rounded(synth.leaked(ch.where("split <> 'train'"), ch.where("split = 'train'"), "said").groupBy("split").agg(F.count("*").alias("n"), evaluation.share(F.col("leaked")).alias("leaked_share")), "leaked_share")


@query(TURN_SQL + """, tr AS (SELECT DISTINCT said FROM ch WHERE split = 'train' AND said IS NOT NULL), l AS (SELECT coalesce(said IN (SELECT said FROM tr), false) AS leaked, length(said) AS size FROM ch WHERE split <> 'train')
SELECT leaked, count(*) AS n, round(avg(size), 6) AS mean_chars FROM l GROUP BY leaked""")
def leaked_split(spark, d):
    ch = _turns(spark, d)
    return rounded(synth.leaked(ch.where("split <> 'train'"), ch.where("split = 'train'"), "said").groupBy("leaked").agg(F.count("*").alias("n"), F.avg(F.length("said")).alias("mean_chars")), "mean_chars")


JSON_SQL = CHAT_SQL + r""", sp AS (SELECT *, regexp_extract(CASE WHEN regexp_extract(output, '(?s)```(?:json)?\s*(.*?)```', 1) <> '' THEN regexp_extract(output, '(?s)```(?:json)?\s*(.*?)```', 1) ELSE output END, '(?s)\{.*\}', 0) AS o, regexp_extract(CASE WHEN regexp_extract(gold, '(?s)```(?:json)?\s*(.*?)```', 1) <> '' THEN regexp_extract(gold, '(?s)```(?:json)?\s*(.*?)```', 1) ELSE gold END, '(?s)\{.*\}', 0) AS g FROM ch),
js AS (SELECT example_id, split, coalesce(o <> '' AND json_valid(o), false) AS json_valid, CASE WHEN o <> '' AND json_valid(o) THEN o::JSON END AS j, CASE WHEN g <> '' AND json_valid(g) THEN g::JSON END AS k FROM sp),
sc AS (SELECT *, coalesce(list_sort(json_keys(j)) = ['action', 'component', 'error_code', 'page_oncall', 'severity'], false) AS schema_valid FROM js)"""


def _scored(spark, d) -> DataFrame:
    return evaluation.scored_outputs(_chat(spark, d), "output", "gold")


@query(JSON_SQL + " SELECT example_id, json_valid FROM sc")
def json_validity(spark, d):
    return _scored(spark, d).select("example_id", "json_valid")


@query(JSON_SQL + " SELECT split, count(*) AS n, round(avg(CASE WHEN json_valid THEN 1.0 ELSE 0 END), 6) AS json_valid, round(avg(CASE WHEN schema_valid THEN 1.0 ELSE 0 END), 6) AS schema_valid FROM sc GROUP BY split")
def schema_validity(spark, d):
    return rounded(_scored(spark, d).groupBy("split").agg(F.count("*").alias("n"), evaluation.share(F.col("json_valid")).alias("json_valid"), evaluation.share(F.col("schema_valid")).alias("schema_valid")), "json_valid", "schema_valid")


_FIELD_SQL = ", ".join(f"coalesce(json_valid AND json_exists(j, '$.{f}') AND CAST(j->'$.{f}' AS VARCHAR) IS NOT DISTINCT FROM CAST(k->'$.{f}' AS VARCHAR), false) AS {f}_ok" for f in evaluation.FIELDS)


@query(JSON_SQL + f", fo AS (SELECT schema_valid, {_FIELD_SQL} FROM sc) SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN {f}_ok THEN 1.0 ELSE 0 END), 6) AS {f}" for f in evaluation.FIELDS) + ", round(avg(CASE WHEN schema_valid AND " + " AND ".join(f"{f}_ok" for f in evaluation.FIELDS) + " THEN 1.0 ELSE 0 END), 6) AS exact FROM fo")
def field_accuracy(spark, d):
    return rounded(evaluation.output_scores(_scored(spark, d)).drop("json_valid", "schema_valid"), *evaluation.FIELDS, "exact")


@query(JSON_SQL + f", fo AS (SELECT example_id, json_valid, schema_valid, {_FIELD_SQL} FROM sc) SELECT example_id, json_valid, schema_valid FROM fo WHERE NOT (schema_valid AND " + " AND ".join(f"{f}_ok" for f in evaluation.FIELDS) + ") ORDER BY example_id LIMIT 8")
def scored_failures(spark, d):
    return evaluation.failures(_scored(spark, d), "example_id").select("example_id", "json_valid", "schema_valid")


def _labels(spark, d) -> DataFrame:
    j = X.parsed_object(F.col("gold"))
    get = lambda f, t="string": F.try_variant_get(F.col("j"), f"$.{f}", t)
    return _chat(spark, d).withColumn("j", j).where("j is not null").select("example_id", "split", get("component").alias("component"), get("severity").alias("severity"), get("error_code").alias("error_code"), get("page_oncall", "boolean").alias("page_oncall"), get("action").alias("action"))


LABEL_SQL = JSON_SQL + """, lb AS (SELECT example_id, split, json_extract_string(k, '$.component') AS component, json_extract_string(k, '$.severity') AS severity, json_extract_string(k, '$.error_code') AS error_code, json_extract_string(k, '$.page_oncall') AS page_oncall, json_extract_string(k, '$.action') AS action FROM sc WHERE k IS NOT NULL)"""


@query(LABEL_SQL + """ SELECT field, value, count(*) AS n FROM (SELECT 'severity' AS field, coalesce(severity, 'null') AS value FROM lb UNION ALL SELECT 'component', coalesce(component, 'null') FROM lb UNION ALL SELECT 'code', coalesce(split_part(error_code, '-', 1), 'null') FROM lb) GROUP BY ALL""")
def class_distribution(spark, d):
    return evaluation.class_distribution(_labels(spark, d), {"severity": F.col("severity"), "component": F.col("component"), "code": F.split_part("error_code", F.lit("-"), F.lit(1))})


@query(LABEL_SQL + " SELECT count(*) AS n, round(avg(CASE WHEN (page_oncall = 'true') = coalesce(severity IN ('SEV1', 'SEV2'), false) THEN 1.0 ELSE 0 END), 6) AS consistent FROM (SELECT coalesce(page_oncall, 'x') AS page_oncall, severity FROM lb)")
def rule_consistency(spark, d):
    return rounded(_labels(spark, d).agg(F.count("*").alias("n"), evaluation.share(evaluation.rule_consistent(F.col("severity"), F.col("page_oncall"))).alias("consistent")), "consistent")


@query(LABEL_SQL + """, tr AS (SELECT * FROM lb WHERE split = 'train'), ev AS (SELECT * FROM lb WHERE split <> 'train'),
cc AS (SELECT component, severity, count(*) AS c FROM tr WHERE severity IS NOT NULL GROUP BY component, severity),
cm AS (SELECT component, severity AS majority FROM (SELECT component, severity, row_number() OVER (PARTITION BY component ORDER BY c DESC, severity) AS r FROM cc) WHERE r = 1),
gm AS (SELECT severity AS overall FROM tr WHERE severity IS NOT NULL GROUP BY severity ORDER BY count(*) DESC, severity LIMIT 1)
SELECT count(*) AS n, round(avg(CASE WHEN severity = overall THEN 1.0 ELSE 0 END), 6) AS global_share, round(avg(CASE WHEN severity = majority THEN 1.0 ELSE 0 END), 6) AS conditional_share FROM ev LEFT JOIN cm USING (component), gm""")
def majority_baseline(spark, d):
    lb = _labels(spark, d)
    return rounded(evaluation.majority_baseline(lb.where("split = 'train'").select("component", "severity"), lb.where("split <> 'train'").select("component", "severity"), "component", "severity"), "global_share", "conditional_share")


# ---------------------------------------------------------------- transcripts


def _transcripts(spark, d) -> DataFrame:
    return table(spark, d, "qa_set").where("question is not null").select("id", "source", F.col("question").alias("ref"), F.expr("replace(replace(question, 'the ', ''), 'corvid-', 'corvid ')").alias("hyp"))


TR_SQL = r"""WITH p AS (SELECT id, lower(trim(source)) AS source, question AS ref, replace(replace(question, 'the ', ''), 'corvid-', 'corvid ') AS hyp FROM qa_set WHERE question IS NOT NULL),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(ref)), '[^\p{L}\p{N}_\s-]', '', 'g'), '\s+', ' ', 'g')) AS r, trim(regexp_replace(regexp_replace(lower(trim(hyp)), '[^\p{L}\p{N}_\s-]', '', 'g'), '\s+', ' ', 'g')) AS h FROM p)"""
WORD_SQL = TR_SQL + """, w AS (SELECT *, string_split(r, ' ') AS rw, string_split(h, ' ') AS hw FROM n), v AS (SELECT *, list_distinct(rw || hw) AS voc FROM w),
m AS (SELECT *, array_to_string(list_transform(rw, lambda x: chr(CAST(list_position(voc, x) + 32 AS INT))), '') AS rc, array_to_string(list_transform(hw, lambda x: chr(CAST(list_position(voc, x) + 32 AS INT))), '') AS hc FROM v)"""


@query(TR_SQL + " SELECT source, count(*) AS n, round(sum(levenshtein(r, h)) / sum(length(r)), 6) AS cer FROM n GROUP BY source")
def cer(spark, d):
    return rounded(evaluation.transcript_scores(_transcripts(spark, d).withColumn("source", F.lower(F.trim("source"))), "ref", "hyp", ["source"]).select("source", "n", "cer"), "cer")


@query(WORD_SQL + " SELECT source, count(*) AS n, round(sum(levenshtein(rc, hc)) / sum(len(rw)), 6) AS wer, round(avg(CASE WHEN r = h THEN 1.0 ELSE 0 END), 6) AS sentence_accuracy FROM m GROUP BY source")
def wer(spark, d):
    return rounded(evaluation.transcript_scores(_transcripts(spark, d).withColumn("source", F.lower(F.trim("source"))), "ref", "hyp", ["source"]).select("source", "n", "wer", "sentence_accuracy"), "wer", "sentence_accuracy")


TERMS = r"\b[A-Z]{2}\d-\d{5}\b|\bcorvid-[a-z]+\b"


@query(TR_SQL + rf", t AS (SELECT h, regexp_extract_all(ref, '{TERMS}') AS ts FROM n) SELECT sum(len(list_filter(ts, lambda x: contains(h, lower(x))))) AS hits, sum(len(ts)) AS terms, round(sum(len(list_filter(ts, lambda x: contains(h, lower(x))))) / sum(len(ts)), 6) AS recall FROM t")
def term_recall(spark, d):
    return rounded(evaluation.term_recall(_transcripts(spark, d), "ref", "hyp", TERMS), "recall")


# ---------------------------------------------------------------- timings and metrics


def _timed(spark, d) -> DataFrame:
    return table(spark, d, "rag_results").select("request_id", F.lower(F.trim("cell")).alias("cell"), "mode", "retrieve_ms", "rerank_ms", "generate_ms", "n_hits", "abstained", "asked_at").distinct()


TIME_SQL = "WITH r AS (SELECT DISTINCT request_id, lower(trim(cell)) AS cell, mode, retrieve_ms, rerank_ms, generate_ms, n_hits, abstained, asked_at FROM rag_results), v AS (SELECT * FROM r WHERE retrieve_ms >= 0 AND NOT isnan(retrieve_ms))"


@query(TIME_SQL + ", l AS (SELECT cell, list_sort(list(retrieve_ms)) AS s, count(*) AS n FROM v GROUP BY cell) SELECT cell, n, " + ", ".join(f"s[1 + CAST(least(n - 1, round_even({p} / 100 * (n - 1), 0)) AS BIGINT)] AS p{p}" for p in (50, 90, 99)) + " FROM l")
def latency_percentiles(spark, d):
    return evaluation.nearest_rank(_timed(spark, d).where("retrieve_ms >= 0 and not isnan(retrieve_ms)"), ["cell"], "retrieve_ms", [50, 90, 99])


@query("""WITH r AS (SELECT DISTINCT run_id, regexp_replace(lower(trim(arm)), '\\s*\\+\\s*', ' + ', 'g') AS arm, p50_ms FROM eval_runs WHERE p50_ms IS NOT NULL)
SELECT arm, count(*) AS runs, round(median(p50_ms), 6) AS median, round(CASE WHEN count(*) > 1 THEN 100 * (max(p50_ms) - min(p50_ms)) / median(p50_ms) ELSE 0 END, 4) AS spread_pct FROM r GROUP BY arm""")
def spread(spark, d):
    return rounded(rounded(evaluation.spread(_runs(spark, d), ["arm"], "p50_ms"), "median"), "spread_pct", digits=4)


def _runs(spark, d) -> DataFrame:
    return table(spark, d, "eval_runs").select("run_id", F.regexp_replace(F.lower(F.trim("arm")), r"\s*\+\s*", " + ").alias("arm"), "p50_ms", "recall_1", "recall_3", "mrr", "n_questions").distinct()


RUN_SQL = "WITH r AS (SELECT DISTINCT run_id, regexp_replace(lower(trim(arm)), '\\s*\\+\\s*', ' + ', 'g') AS arm, p50_ms, recall_1, recall_3, mrr, n_questions FROM eval_runs)"


@query(RUN_SQL + ", m AS (SELECT arm, median(p50_ms) AS v FROM r GROUP BY arm) SELECT arm AS variant, round(v, 6) AS value, round(v / (SELECT v FROM m WHERE arm = 'dense'), 6) AS ratio FROM m")
def relative_ratio(spark, d):
    return rounded(evaluation.relative_to(medians(_runs(spark, d).withColumnRenamed("arm", "variant"), ["variant"], "p50_ms", "v"), "variant", "v", "dense"), "value", "ratio")


@query(RUN_SQL + """, m AS (SELECT arm, 'recall_1' AS metric, avg(recall_1) AS v FROM r GROUP BY arm UNION ALL SELECT arm, 'mrr', avg(mrr) FROM r GROUP BY arm)
SELECT a.arm, a.metric, round(b.v, 6) AS base, round(a.v, 6) AS value, round(a.v - b.v, 6) AS absolute, round((a.v - b.v) / b.v, 6) AS relative, a.v - b.v > 0.05 AS forgetting FROM m a JOIN m b ON b.metric = a.metric AND b.arm = 'dense' WHERE a.arm <> 'dense'""")
def delta_table(spark, d):
    r = _runs(spark, d)
    m = r.groupBy("arm").agg(F.avg("recall_1").alias("v")).withColumn("metric", F.lit("recall_1")).unionByName(r.groupBy("arm").agg(F.avg("mrr").alias("v")).withColumn("metric", F.lit("mrr")))
    return rounded(evaluation.delta_table(m, "arm", "dense", "metric", "v"), "base", "value", "absolute", "relative")


@query(TIME_SQL + ", m AS (SELECT n_hits, median(retrieve_ms) AS ms FROM v GROUP BY n_hits), t AS (SELECT max(n_hits) AS measured, max_by(ms, n_hits) AS cost FROM m) SELECT measured, round(cost, 6) AS cost, round(cost * 1000 / measured + 2, 6) AS projected, cost * 1000 / measured + 2 > 300 AS too_slow FROM t")
def projection(spark, d):
    m = medians(_timed(spark, d).where("retrieve_ms >= 0"), ["n_hits"], "retrieve_ms", "ms")
    return rounded(evaluation.linear_projection(m, "n_hits", "ms", 1000, 2.0), "cost", "projected")


@query(TIME_SQL + " SELECT mode, count(*) AS n, round(1000 / median(retrieve_ms), 6) AS qps_median, round(1000 * count(*) / sum(retrieve_ms), 6) AS qps_total FROM v WHERE retrieve_ms > 0 GROUP BY mode")
def throughput(spark, d):
    return rounded(evaluation.throughput(_timed(spark, d).where("not isnan(retrieve_ms)"), ["mode"], "retrieve_ms"), "qps_median", "qps_total")


def _measured(c: str):
    return F.when((F.col(c) >= 0) & ~F.isnan(c), F.col(c)).otherwise(0.0)


@query(TIME_SQL + """, z AS (SELECT mode, CASE WHEN retrieve_ms >= 0 AND NOT isnan(retrieve_ms) THEN retrieve_ms ELSE 0 END AS busy, CASE WHEN rerank_ms >= 0 AND NOT isnan(rerank_ms) THEN rerank_ms ELSE 0 END AS wait, CASE WHEN generate_ms >= 0 AND NOT isnan(generate_ms) THEN generate_ms ELSE 0 END AS write FROM r)
SELECT mode, round(sum(busy), 3) AS busy, round(sum(wait), 3) AS wait, round(sum(write), 3) AS write, round(sum(busy) / (sum(busy) + sum(wait) + sum(write)), 6) AS busy_share, round(sum(wait) / (sum(busy) + sum(wait) + sum(write)), 6) AS wait_share, round(sum(write) / (sum(busy) + sum(wait) + sum(write)), 6) AS write_share FROM z GROUP BY mode""")
def stage_accounting(spark, d):
    z = _timed(spark, d).select("mode", _measured("retrieve_ms").alias("busy"), _measured("rerank_ms").alias("wait"), _measured("generate_ms").alias("write"))
    return rounded(rounded(evaluation.stage_accounting(z, ["mode"]), "busy_share", "wait_share", "write_share"), "busy", "wait", "write", digits=3)


@query("SELECT round(exp(avg(l_discount * 10)), 6) AS perplexity FROM lineitem")
def perplexity(spark, d):
    return rounded(evaluation.perplexity(table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("loss")), "loss"), "perplexity")


@query(TIME_SQL + """, a AS (SELECT mode, n_hits > 3 AS answerable, n_hits > 5 AS facts, abstained, n_hits % 2 = 0 AS cited, n_hits > 4 AS gold, retrieve_ms AS ms FROM v)
SELECT mode, round(coalesce(avg(CASE WHEN answerable THEN CASE WHEN facts AND NOT abstained THEN 1.0 ELSE 0 END END), 0), 6) AS fact_recall, round(coalesce(avg(CASE WHEN answerable THEN CASE WHEN cited THEN 1.0 ELSE 0 END END), 0), 6) AS citation_valid,
round(coalesce(avg(CASE WHEN answerable THEN CASE WHEN gold THEN 1.0 ELSE 0 END END), 0), 6) AS gold_in_context, round(coalesce(avg(CASE WHEN NOT answerable THEN CASE WHEN abstained THEN 1.0 ELSE 0 END END), 0), 6) AS abstain_correct, round(median(ms), 6) AS p50_ms FROM a GROUP BY mode""")
def generation_metrics(spark, d):
    return rounded(evaluation.generation_metrics(_judged(spark, d), ["mode"]), "fact_recall", "citation_valid", "gold_in_context", "abstain_correct", "p50_ms")


def _judged(spark, d) -> DataFrame:
    return _timed(spark, d).where("retrieve_ms >= 0 and not isnan(retrieve_ms)").selectExpr(
        "mode", "n_hits > 3 as answerable", "n_hits > 5 as facts_found", "abstained", "n_hits % 2 = 0 as citations_ok", "n_hits > 4 as gold_in_context", "retrieve_ms as ms", "n_hits as calls"
    )


@query(TIME_SQL + """ SELECT mode, round(avg(CASE WHEN n_hits > 3 THEN CASE WHEN n_hits > 5 AND NOT abstained THEN 1.0 ELSE 0 END END), 6) AS fact_recall, round(avg(CASE WHEN n_hits <= 3 THEN CASE WHEN abstained THEN 1.0 ELSE 0 END END), 6) AS abstain_rate, round(median(retrieve_ms), 6) AS p50_ms, round(avg(n_hits), 6) AS mean_calls FROM v GROUP BY mode""")
def paradigm_metrics(spark, d):
    return rounded(evaluation.paradigm_metrics(_judged(spark, d), ["mode"]), "fact_recall", "abstain_rate", "p50_ms", "mean_calls")


@query("""WITH h AS (SELECT DISTINCT query_id, hit_rank, chunk_id, score FROM hits), v AS (SELECT query_id, count_if(coalesce(score > 0.3, false)) / count(*) AS precision, max(score) AS relevance FROM h GROUP BY query_id)
SELECT query_id, round(precision, 6) AS context_precision, round(relevance, 6) AS answer_relevance, round(CASE WHEN relevance IS NULL THEN precision ELSE (precision + relevance) / 2 END, 6) AS overall FROM v""")
def ragas_scores(spark, d):
    h = table(spark, d, "hits").select("query_id", "hit_rank", "chunk_id", "score").distinct()
    v = h.groupBy("query_id").agg(evaluation.ragas_ratio(F.collect_list(F.coalesce(F.col("score") > 0.3, F.lit(False)))).alias("context_precision"), F.max("score").alias("answer_relevance"))  # a query has few hits
    return rounded(v.withColumn("overall", evaluation.ragas_overall(F.col("context_precision"), F.col("answer_relevance"))), "context_precision", "answer_relevance", "overall")


JUDGED = "CASE n_hits % 3 WHEN 0 THEN concat('{\"verdicts\": [{\"useful\": true}, {\"useful\": ', CASE WHEN n_hits > 4 THEN 'true' ELSE 'false' END, '}]}') WHEN 1 THEN 'as asked: {\"verdicts\": [{\"useful\": false}, {}, {\"useful\": true}]}' ELSE 'no verdict' END"


@query("WITH r AS (SELECT DISTINCT request_id, n_hits FROM rag_results WHERE n_hits IS NOT NULL) SELECT request_id, round(CASE n_hits % 3 WHEN 0 THEN CASE WHEN n_hits > 4 THEN 1.0 ELSE 0.5 END WHEN 1 THEN 1.0 / 3 ELSE 0 END, 6)::DOUBLE AS context_precision, CAST(CASE n_hits % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS INT) AS judged FROM r")
def judged_precision(spark, d):
    rows = table(spark, d, "rag_results").where("n_hits is not null").select("request_id", "n_hits").distinct().select("request_id", F.expr(JUDGED).alias("output"))
    v = rows.select("request_id", evaluation.context_precision(F.col("output")).alias("p"))
    return v.select("request_id", F.round("p.share", 6).alias("context_precision"), F.col("p.n").alias("judged"))


@query(E_SQL + """, x AS (SELECT q.query, list_inner_product(q.qv, e.v) / sqrt(list_inner_product(q.qv, q.qv) * list_inner_product(e.v, e.v)) AS c FROM q LEFT JOIN e ON e.vec_id > q.query AND e.vec_id <= q.query + 3)
SELECT query, round(coalesce(avg(c), 0), 6) AS relevance FROM x GROUP BY query""")
def answer_relevance(spark, d):
    made = _vectors(spark, d).select(F.expr("cast((vec_id - 1) div 50 * 50 as bigint)").alias("query"), "vec_id", "v").where("vec_id > query and vec_id <= query + 3").select("query", "v")
    return rounded(evaluation.answer_relevance(_asked(spark, d).select("query", F.col("qv").alias("v")), made, "query", "v"), "relevance")


@query(E_SQL + """, u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM e), x AS (SELECT label, unnest(range(0, 64)) AS d, unnest(u) AS x FROM u),
c AS (SELECT list(x ORDER BY d) AS c FROM (SELECT d, avg(x) AS x FROM x WHERE label = 0 GROUP BY d)), m AS (SELECT label, avg(list_inner_product(u, c) / sqrt(list_inner_product(c, c))) AS m FROM u, c WHERE label <> 0 GROUP BY label) SELECT round(avg(m), 6) AS value FROM m""")
def concept_fidelity(spark, d):
    v = _vectors(spark, d)
    return rounded(dense.concept_fidelity(v.where("label <> 0"), "label", "v", v.where("label = 0"), "v"), "value")


@query(TIME_SQL + """, s AS (SELECT n_hits AS level, epoch(asked_at) AS a, epoch(asked_at) + retrieve_ms / 1000 AS b FROM v WHERE asked_at IS NOT NULL), l AS (SELECT level, list_sort(list((b - a) * 1000)) AS t, count(*) AS n, max(b) - min(a) AS wall FROM s GROUP BY level),
z AS (SELECT *, n / wall AS qps FROM l) SELECT level, n, round(wall, 3) AS wall_s, round(qps, 9) AS qps, round(t[1 + CAST(least(n - 1, round_even(0.5 * (n - 1), 0)) AS BIGINT)], 1) AS p50_ms, round(t[1 + CAST(least(n - 1, round_even(0.99 * (n - 1), 0)) AS BIGINT)], 1) AS p99_ms,
round(qps / first_value(qps) OVER (ORDER BY level NULLS LAST), 6) AS speedup FROM z""")
def concurrency_sweep(spark, d):
    start = F.unix_micros(F.col("asked_at").cast("timestamp")) / 1e6
    calls = _timed(spark, d).where("retrieve_ms >= 0 and not isnan(retrieve_ms) and asked_at is not null").select(F.col("n_hits").alias("level"), start.alias("a"), (start + F.col("retrieve_ms") / 1000).alias("b"))
    each = evaluation.concurrency_sweep(calls, "level", "a", "b")
    return rounded(rounded(rounded(rounded(each, "speedup"), "qps", digits=9), "wall_s", digits=3), "p50_ms", "p99_ms", digits=1)


@query("SELECT chunk_key, CASE WHEN trim(coalesce(source, '')) <> '' THEN trim(source) || chr(10) || chr(10) || body ELSE body END AS contextual FROM chunks WHERE body IS NOT NULL AND text IS NOT NULL")
def contextual_prefix(spark, d):
    ready = table(spark, d, "chunks").where("body is not null and text is not null").select("chunk_key", "text", "body", "source")
    return X.contextual_chunks(ready, "text", "body", lambda df: df.withColumn("context", F.col("source"))).select("chunk_key", "contextual")


@query("SELECT time_bucket(INTERVAL '1 hour', asked_at) AS window_start, mode, count(*) AS n, round(avg(retrieve_ms), 6) AS mean_value, max(retrieve_ms) AS max_value FROM (" + TIME_SQL + " SELECT * FROM v) WHERE asked_at IS NOT NULL GROUP BY ALL")
def hourly_latency(spark, d):
    return rounded(windowed_latency(_timed(spark, d).where("retrieve_ms >= 0 and not isnan(retrieve_ms) and asked_at is not null"), "asked_at", "mode", "retrieve_ms"), "mean_value")


# ---------------------------------------------------------------- sampling, sources, index, access


@query("SELECT s_name, CAST(s_suppkey AS BIGINT) AS size FROM (SELECT s_name, s_suppkey, sum(s_suppkey) OVER (ORDER BY s_name) AS running FROM supplier) WHERE running - s_suppkey < 1000")
def shard_prefix(spark, d):
    return synth.running_prefix(table(spark, d, "supplier").select("s_name", F.col("s_suppkey").cast("bigint").alias("size")), "s_name", "size", 1000).select("s_name", "size")


@query("SELECT doc_id, substr(text, 1, 1200) AS body FROM documents WHERE length(text) > 200 ORDER BY doc_id LIMIT 100")
def distractors(spark, d):
    from rookery.sources.readers import distractors as load

    return load(table(spark, d, "documents"), "text", "doc_id", 100)


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0 ORDER BY vec_id LIMIT 50")
def strided_sample(spark, d):
    return synth.strided_sample(table(spark, d, "embeddings").select("vec_id"), "vec_id", 7, 50)


@query()
def fixed_sample(spark, d):
    return synth.fixed_sample(table(spark, d, "embeddings").select("vec_id"), "vec_id", 100, 42)


@query("SELECT root, count(*) AS n FROM (SELECT 'train' AS root FROM chat_examples UNION ALL SELECT 'qa' FROM qa_set, range(3)) GROUP BY root")
def oversampled_union(spark, d):
    both = synth.oversampled(table(spark, d, "chat_examples").select(F.col("example_id").alias("id")), table(spark, d, "qa_set").select("id"), 3, "train", "qa")
    return both.groupBy("root").agg(F.count("*").alias("n"))


@query(CHAT_SQL + """, t AS (SELECT example_id, string_split(said, ' ') AS p, string_split(output, ' ') AS c FROM ch WHERE said IS NOT NULL AND output IS NOT NULL)
SELECT example_id, CAST(greatest(len(p) + len(c), 256) AS INT) AS width, CAST(len(c) AS INT) AS trained FROM t""")
def completion_labels(spark, d):
    t = _chat(spark, d).where("said is not null and output is not null").select("example_id", F.split("said", " ").alias("p"), F.split("output", " ").alias("c"))
    ids = F.transform(F.concat("p", "c"), lambda w: F.length(w))
    x = t.select("example_id", synth.completion_labels(ids, F.size("p"), F.lit(256), 0).alias("x"))
    return x.select("example_id", F.size("x.input_ids").alias("width"), F.size(F.filter("x.labels", lambda v: v != -100)).alias("trained"))


@query()
def synthetic_incidents(spark, d):
    names = [r.n_name.lower() for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # one per nation, a fixed table
    choices = {"component": names[:5], "code": ["TLM-101", "CON-202", "VIS-303"], "severity": ["SEV1", "SEV2", "SEV3"], "cell": names[5:], "symptom": ["is stuck", "drifts", "restarts"], "action": ["restart", "inspect", "page"]}
    made = synth.incident_examples(spark, 2000, 7, choices, ["{component} at {cell} {symptom} {code}", "In {cell} the {component} {symptom}. {code}"], "Return JSON only.")
    return synth.distinct_examples(made, F.col("messages")[1]["content"], 500).select("id", F.col("messages")[1]["content"].alias("report"), F.col("messages")[2]["content"].alias("label"))


def _store(spark) -> IndexStore:
    import uuid

    return IndexStore(spark, f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}")


def _shards(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lower(F.trim(F.coalesce("source", F.lit("none")))), F.lit(".parquet")).alias("shard_file"), F.col("doc_id").alias("row"), "text")
    return chunk_shards(docs)


@query(SPAN_SQL + " SELECT lower(trim(coalesce(d.source, 'none'))) || '.parquet' AS shard_file, count(*) AS n_chunks, sum(char_end - char_start) AS text_chars, 'hash-64' AS model, 64 AS dim FROM sp JOIN documents d USING (doc_id) GROUP BY 1")
def index_commit(spark, d):
    store = _store(spark)
    store.commit(_shards(spark, d), "hash-64", 64)
    return store.manifest()


@query(SPAN_SQL + " SELECT lower(trim(coalesce(d.source, 'none'))) || '.parquet' AS shard_file, count(*) AS n FROM sp JOIN documents d USING (doc_id) GROUP BY 1")
def incremental_index(spark, d):
    store, rows = _store(spark), _shards(spark, d)
    first = rows.where("shard_file < 'm'")
    store.commit(first, "hash-64", 64)
    left = store.todo(rows.select("shard_file").distinct())
    store.commit(rows.join(left, "shard_file", "left_semi"), "hash-64", 64)
    return store.open("hash-64").groupBy("shard_file").agg(F.count("*").alias("n"))


def _calls(spark, d) -> DataFrame:
    tool = F.get(F.array(*[F.lit(t) for t in ("list_documents", "search", "ask", "triage", "reboot")]), F.pmod("event_id", F.lit(5)).cast("int"))
    scopes = F.when(F.pmod("user_id", F.lit(3)) == 0, F.array(F.lit("docs:read"))).when(F.pmod("user_id", F.lit(3)) == 1, F.array(F.lit("docs:read"), F.lit("docs:ask"))).otherwise(F.array(F.lit("incidents:triage")))
    return table(spark, d, "events").select("event_id", tool.alias("tool"), scopes.alias("scopes"))


@query("""WITH c AS (SELECT event_id, ['list_documents', 'search', 'ask', 'triage', 'reboot'][event_id % 5 + 1] AS tool, CASE user_id % 3 WHEN 0 THEN ['docs:read'] WHEN 1 THEN ['docs:read', 'docs:ask'] ELSE ['incidents:triage'] END AS scopes FROM events),
n AS (SELECT *, CASE tool WHEN 'list_documents' THEN 'docs:read' WHEN 'search' THEN 'docs:read' WHEN 'ask' THEN 'docs:ask' WHEN 'triage' THEN 'incidents:triage' END AS scope FROM c)
SELECT event_id, tool, coalesce(list_contains(scopes, scope), false) AS allowed, CASE WHEN NOT coalesce(list_contains(scopes, scope), false) THEN scope END AS missing FROM n""")
def scope_check(spark, d):
    return access.scope_checks(_calls(spark, d)).select("event_id", "tool", "allowed", "missing")


@query("""WITH c AS (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN ['docs:read'] WHEN 1 THEN ['docs:read', 'docs:ask'] ELSE ['incidents:triage'] END AS scopes FROM events),
t AS (SELECT * FROM (VALUES (1, 'list_documents', 'docs:read'), (2, 'search', 'docs:read'), (3, 'ask', 'docs:ask'), (4, 'triage', 'incidents:triage')) v(n, tool, scope))
SELECT array_to_string(scopes, ' ') AS scopes, string_agg(tool, ',' ORDER BY n) AS tools FROM c JOIN t ON list_contains(scopes, scope) GROUP BY scopes""")
def allowed_tools(spark, d):
    return _calls(spark, d).select(F.array_join("scopes", " ").alias("scopes"), F.array_join(access.allowed_tools(F.col("scopes")), ",").alias("tools")).distinct()


@query("""SELECT c_custkey, rtrim(translate(base64(unhex(sha256(c_name || '-verifier'))), '+/', '-_'), '=') AS challenge, true AS valid, false AS plain_valid FROM customer""")
def pkce_challenges(spark, d):
    v = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("-verifier")).alias("v"))
    c = access.pkce_challenge(F.col("v"))
    return v.select("c_custkey", c.alias("challenge"), access.pkce_valid(F.col("v"), c, F.lit("S256")).alias("valid"), access.pkce_valid(F.col("v"), c, F.lit("plain")).alias("plain_valid"))


@query("""WITH c AS (SELECT event_id // 6 AS client, bool_or(event_id % 6 = 0) AND bool_or(event_id % 6 = 1) AS granted, bool_or(event_id % 6 = 0) AS coded FROM events GROUP BY 1),
e AS (SELECT event_id % 6 AS k, granted, coded FROM events JOIN c ON client = event_id // 6),
o AS (SELECT ['authorize', 'exchange', 'use', 'refresh', 'use', 'revoke'][k + 1] AS event, CASE k WHEN 0 THEN 'issued' WHEN 1 THEN CASE WHEN coded THEN 'tokens' ELSE 'code_replay' END WHEN 3 THEN CASE WHEN granted THEN 'rotated' ELSE 'invalid_refresh' END
WHEN 5 THEN CASE WHEN granted THEN 'revoked_all' ELSE 'unknown' END ELSE CASE WHEN granted THEN 'ok' ELSE 'denied' END END AS outcome FROM e) SELECT event, outcome, count(*) AS n FROM o GROUP BY ALL""")
def token_replay(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"))
    kind = F.get(F.array(*[F.lit(x) for x in ("authorize", "exchange", "use", "refresh", "use", "revoke")]), F.pmod("seq", F.lit(6)).cast("int"))
    name = F.expr("cast(seq div 6 as string)")
    token = F.when(kind.isin("authorize", "exchange"), F.concat(F.lit("ac"), name)).when(kind.isin("refresh", "revoke"), F.concat(F.lit("rt"), name)).otherwise(F.concat(F.lit("at"), name))
    log = e.select((F.expr("seq div 6")).alias("client"), F.col("seq").cast("double").alias("ts"), "seq", kind.alias("event"), token.alias("token"), F.array(F.lit("docs:read"), F.lit("docs:ask")).alias("scopes"), F.concat(F.lit("at"), name).alias("access"), F.concat(F.lit("rt"), name).alias("refresh"))
    return access.token_replay(log).groupBy("event", "outcome").agg(F.count("*").alias("n"))


@query()
def audio_quality(spark, d):
    clip = F.transform(F.flatten(F.array_repeat("embedding", 100)), lambda x: F.when(F.col("label") == 0, x * 0.01).otherwise(x).cast("float"))
    e = table(spark, d, "embeddings").select("vec_id", "label", clip.alias("samples"))
    out = audio.trim_silence(e, "samples")
    return out.select("vec_id", F.array_join(audio.quality_flags(F.col("samples")), ",").alias("flags"), F.size("trimmed").alias("kept"), F.round(F.array_max(audio.peak_normalised(F.col("samples"))), 4).alias("peak"))


@query()
def audio_augmented(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.flatten(F.array_repeat("embedding", 60)).alias("samples"), F.lit(8000).alias("rate"))
    both = audio.augment(audio.resampled(e, "samples", "rate"), "resampled", "vec_id", 3)
    return both.select("vec_id", F.size("resampled").alias("n"), F.round(F.array_max(F.transform("augmented", lambda x: F.abs(x))), 3).alias("peak"))


def _engine(spark, d) -> Engine:
    chunks = table(spark, d, "chunks").where("body is not null").select(F.col("chunk_key").alias("id"), "body", "source", "breadcrumb").withColumn("embedding", seams.embed()(F.col("body")))
    return Engine(chunks, generate=lambda df: df.withColumn("text", F.when(F.col("n_blocks") > 0, F.lit("See [1].")).otherwise("NOT_FOUND")))


@query()
def service_search(spark, d):
    return _engine(spark, d).search(all_questions(spark, d).withColumnRenamed("query", "qid")).select("query", "item", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query()
def service_ask(spark, d):
    return _engine(spark, d).ask(all_questions(spark, d).withColumnRenamed("query", "qid")).select("query", "text", "grounded", "abstained", "n_blocks")


@query()
def service_compare(spark, d):
    return _engine(spark, d).compare(all_questions(spark, d).withColumnRenamed("query", "qid"))


@query()
def service_ask_stream(spark, d):
    return _engine(spark, d).ask_stream(all_questions(spark, d).withColumnRenamed("query", "qid"))


@query(CHAT_SQL + """, r AS (SELECT example_id AS qid, output AS raw, CASE WHEN regexp_extract(output, '(?s)```(?:json)?\\s*(.*?)```', 1) <> '' THEN regexp_extract(output, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE output END AS t FROM ch WHERE said IS NOT NULL),
j AS (SELECT qid, raw, regexp_extract(t, '(?s)\\{.*\\}', 0) AS o FROM r), k AS (SELECT qid, raw, CASE WHEN o <> '' AND json_valid(o) THEN o::JSON END AS k FROM j)
SELECT qid, json_extract_string(k, '$.component') AS component, json_extract_string(k, '$.severity') AS severity, CASE WHEN k IS NULL THEN 'model did not return valid JSON' END AS error FROM k""")
def service_triage(spark, d):
    ch = _chat(spark, d).where("said is not null")
    reports, said = ch.select(F.col("example_id").alias("qid"), F.col("said").alias("report")), ch.select(F.col("example_id").alias("qid"), F.col("output").alias("raw"))
    return _engine(spark, d).triage(reports, lambda df: df.join(said, "qid")).select("qid", "component", "severity", "error")


@query(SPAN_SQL + " SELECT 'ok' AS status, count(DISTINCT lower(trim(coalesce(d.source, 'none')))) AS shards, count(*) AS n_chunks, CAST(sum(char_end - char_start) AS BIGINT) AS text_chars, 'hash-64' AS model, 64 AS dim, (SELECT count(*) FROM documents) AS documents FROM sp JOIN documents d USING (doc_id)")
def service_index_stats(spark, d):
    store = _store(spark)
    store.commit(_shards(spark, d), "hash-64", 64)
    return index_stats(store, table(spark, d, "documents"))
