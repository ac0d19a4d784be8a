"""BM25 (Okapi) over an inverted index of DataFrames.

k1 = 1.5, b = 0.75, epsilon = 0.25; idf = ln(N - df + 0.5) - ln(df + 0.5), and a negative idf
becomes epsilon times the mean idf of the vocabulary (the mean includes the negative ones).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import found_tokens, stretches, tokens
from rookery.session import drop, materialise, together

K1, B, EPSILON = 1.5, 0.75, 0.25

#: Bytes of query terms that a task holds, at about TERM_BYTES each; queries and documents scored at
#: a time, postings read for that, sums formed singly at a time, and terms at most that are multiplied
#: as a matrix: those whose sums, formed singly, are more than one of so many pairs.
QUERY_BYTES, TERM_BYTES, QUERY_ROWS, DOC_ROWS, POSTINGS, SINGLY, DENSE_TERMS, DENSE_SHARE = 64 << 20, 64, 1024, 2048, 1 << 17, 1 << 22, 256, 800
#: Weights whose sums are estimated in single precision are less than LARGE and more than its inverse;
#: queries are summed in double at once until only one in UNBOUND has no k-th best yet.
LARGE, UNBOUND = 1e12, 32
#: Stored documents taken apart at a time.
UNPACKED = 1024
#: Terms whose counts a task holds before it hands them on.
COUNTED = 1 << 18


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf); a document without terms has no row, a null text none."""
    return docs.select(F.col(doc).alias("doc"), F.explode(tokens(F.col(text))).alias("term")).groupBy("doc", "term").agg(F.count("*").cast("int").alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences per term."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def lengths(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, dl): tokens per document, 0 included; null texts count as empty."""
    return docs.select(F.col(doc).alias("doc"), F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).alias("dl"))


def index(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, dl, term, tf): postings that carry their document's length."""
    t = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("ts"))
    return t.select("doc", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").cast("int").alias("tf"))


def _packed(docs: pa.Array, terms: pa.ListArray, tfs: np.ndarray, dls: np.ndarray) -> pa.RecordBatch:
    """A row of a stored index for each document: its terms as one string, and int32 values of each as bytes."""
    at = pa.py_buffer((terms.offsets.to_numpy() * 4).astype(np.int32))
    numbers = (pa.Array.from_buffers(pa.binary(), len(docs), [None, at, pa.py_buffer(np.ascontiguousarray(x, np.int32))]) for x in (tfs, dls))
    return pa.RecordBatch.from_arrays([docs, pa.compute.binary_join(terms, " "), *numbers], names=["doc", "terms", "tfs", "dls"])


def _values(column: pa.Array) -> np.ndarray:
    """The int32 values of all rows of tfs or dls, in order."""
    if not len(column):
        return np.empty(0, np.int32)
    column = column.cast(pa.binary())
    low, high = np.frombuffer(column.buffers()[1], np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(column.buffers()[2], np.int32, (high - low) // 4, low)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_packed() of (doc, lower-case text); a document without terms has no row."""
    for batch in batches:
        for low, high in stretches(batch.column(1)):
            part = batch.slice(low, high - low)
            row, words = found_tokens(part.column(1))
            if not len(row):
                continue
            words = words.dictionary_encode()
            key, tfs = np.unique(row * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
            row, at = np.bincount(row, minlength=len(part)), key % len(words.dictionary)
            sizes = np.bincount(key // len(words.dictionary), minlength=len(part))
            held = np.flatnonzero(sizes)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[held]))), pa.int32())
            yield _packed(part.column(0).take(pa.array(held)), pa.ListArray.from_arrays(offsets, words.dictionary.take(pa.array(at))), tfs, np.repeat(row, sizes))


def stored_index(docs: DataFrame, doc: str, text: str, counted: bool = False) -> DataFrame:
    """(doc, terms, tfs, dls), a row per document, written to the shared folder: index() with each
    document's postings in one place, so that no search has to bring them together. terms are joined
    by spaces, tfs and dls are int32 values as bytes: lists of some 80 values would be most of the work.

    Texts are counted where they lie, without a shuffle; only documents given more than once are
    brought together, as index() does. With counted the terms' frequencies, which every search needs, are
    made while that is looked up, and kept beside the index; else the first search makes them."""
    kind = f"doc {dict(docs.dtypes)[doc]}, terms string, tfs binary, dls binary"
    held = docs.select(F.col(doc).alias("doc"), F.lower(F.col(text)).alias("text"))
    stored = materialise(held.mapInArrow(_counted, kind))
    once = lambda: stored.groupBy("doc").count().where("count > 1").isEmpty()
    unique, *terms = together(stored.sparkSession, once, *([lambda: materialise(_frequencies(stored))] if counted else []))
    if unique:
        stored._rookery_terms = terms[0] if terms else None
        return stored
    for table in terms:
        drop(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy()))), pa.int32()), terms.flatten())
            yield _packed(batch.column(0), lists, *(batch.column(i).flatten().to_numpy() for i in (2, 3)))

    each = unpacked(stored).groupBy("doc", "dl", "term").agg(F.sum("tf").cast("int").alias("tf")).groupBy("doc").agg(F.collect_list(F.struct("term", "tf", "dl")).alias("p"))
    merged = materialise(each.select("doc", *[F.col("p")[c].alias(f"{c}s") for c in ("term", "tf", "dl")]).mapInArrow(run, kind))
    drop(stored)
    return merged


def unpacked(stored: DataFrame) -> DataFrame:
    """(doc, dl, term, tf) of a stored_index()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), UNPACKED):
                part = batch.slice(low, UNPACKED)
                terms = pa.compute.split_pattern(part.column(1), " ")
                doc = part.column(0).take(pa.compute.list_parent_indices(terms))
                yield pa.RecordBatch.from_arrays([doc, pa.array(_values(part.column(3))), terms.flatten(), pa.array(_values(part.column(2)))], names=["doc", "dl", "term", "tf"])

    return stored.select("doc", "terms", "tfs", "dls").mapInArrow(run, f"doc {dict(stored.dtypes)['doc']}, dl int, term string, tf int")


def _frequencies(stored: DataFrame) -> DataFrame:
    """document_frequency() of a stored_index(), counted within each task first, up to COUNTED terms at a time."""

    def summed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        terms, df, cf = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
        terms = terms.dictionary_encode()
        at, n = terms.indices.to_numpy(), len(terms.dictionary)
        sums = (pa.array(np.bincount(at, x.to_numpy(), n).astype(np.int64)) for x in (df, cf))
        return pa.RecordBatch.from_arrays([terms.dictionary, *sums], names=["term", "df", "cf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            terms = pa.compute.split_pattern(batch.column(0), " ").flatten()
            each = pa.RecordBatch.from_arrays([terms, pa.array(np.ones(len(terms), np.int64)), pa.array(_values(batch.column(1)))], names=["term", "df", "cf"])
            held.append(summed([each]))
            if sum(len(b) for b in held) > COUNTED:
                held = [summed(held)]
                if len(held[0]) > COUNTED // 2:
                    yield held.pop()
        if held:
            yield summed(held)

    return stored.select("terms", "tfs").mapInArrow(run, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def best(rows: np.ndarray, order: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k least scores (to nine decimals), ties by `order`; sorted."""
    at = np.lexsort((order, np.round(scores, 9), rows))
    r = rows[at]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return at[place < k]


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, place of each posting's, term, weight) of (doc, term, w) sorted by doc: at most
    DOC_ROWS documents at a time, each with all its postings."""

    def cut(held: list[pa.RecordBatch], last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column(0).combine_chunks().dictionary_encode("encode")  # in order of appearance, null included
        at, term, w = ids.indices.to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy()
        whole = len(ids.dictionary) - (not last)  # the last may go on in the next batch
        for low in range(0, whole, DOC_ROWS):
            i, j = np.searchsorted(at, (low, min(low + DOC_ROWS, whole)))
            yield ids.dictionary.slice(low, min(DOC_ROWS, whole - low)), at[i:j] - low, term[i:j], w[i:j]
        return table.slice(int(np.searchsorted(at, whole))).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= POSTINGS:
            held = yield from cut(held, False)
    if held:
        yield from cut(held, True)


def _parts(at: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, asked: tuple[np.ndarray, np.ndarray, np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray, Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """(q, d, singly) of what _sums returns: frequent terms as two matrices, the others' as (query * n + document,
    qf * w), about SINGLY at a time."""
    row, of, qf, starts = asked
    often = np.diff(starts)
    work = often * np.bincount(term, minlength=len(often))
    heavy = np.flatnonzero(work * DENSE_SHARE > m * n)
    heavy = heavy[np.argsort(-work[heavy], kind="stable")[:DENSE_TERMS]]
    place = np.full(len(often), -1)
    place[heavy] = np.arange(len(heavy))
    left, here = place[of] >= 0, place[term] >= 0
    q = np.zeros((m, len(heavy)))
    q[row[left], place[of[left]]] = qf[left]
    d = np.bincount(place[term[here]] * n + at[here], w[here], len(heavy) * n).reshape(len(heavy), n)
    here = ~here & (often[term] > 0)
    at, term, w = at[here], term[here], w[here]

    def singly() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends, low = np.cumsum(often[term]), 0
        while low < len(term):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SINGLY, "right")))
            c = often[term[low:high]]
            e = np.repeat(starts[term[low:high]] - np.cumsum(c) + c, c) + np.arange(c.sum())
            yield row[e] * n + np.repeat(at[low:high], c), qf[e] * np.repeat(w[low:high], c)
            low = high

    return q, d, singly


def _sums(at: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, asked: tuple[np.ndarray, np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """sum of qf * w over the shared terms, for each of m queries and n documents. asked: (query, term,
    qf) as arrays, and the first place of each term's. Frequent terms are multiplied as a matrix."""
    q, d, singly = _parts(at, term, w, n, asked, m)
    s = q @ d
    for pair, x in singly():
        s += np.bincount(pair, x, m * n).reshape(m, n)
    return s


def _reaching(at: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, asked: tuple[np.ndarray, np.ndarray, np.ndarray], m: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, sum) of the pairs that share a term and whose sum is at least `need` of their query
    (-inf for any), of weights between 1 / LARGE and LARGE. All are summed in single precision, which is off
    by less than a share `gap` as nothing is negative, and in double only the pairs that may get there."""
    q, d, singly = _parts(at, term, w, n, asked, m)
    s = (q.astype(np.float32) @ d.astype(np.float32)).ravel()
    for pair, x in singly():
        np.add.at(s, pair, x.astype(np.float32))
    gap = (np.bincount(asked[0], minlength=1).max() + 8) * 2.0**-23
    least = np.nextafter((need - np.maximum(need, 0) * gap - 1e-9).astype(np.float32), np.float32(-np.inf))
    maybe = s.reshape(m, n) >= np.maximum(least, np.nextafter(np.float32(0), np.float32(1)))[:, None]
    found, maybe = np.flatnonzero(maybe), maybe.ravel()
    i, j, d, s = found // n, found % n, np.ascontiguousarray(d.T), np.empty(len(found))
    for low in range(0, len(found), DOC_ROWS):
        s[low : low + DOC_ROWS] = np.einsum("ij,ij->i", q[i[low : low + DOC_ROWS]], d[j[low : low + DOC_ROWS]])
    for pair, x in singly():
        here = np.flatnonzero(maybe[pair])
        s += np.bincount(np.searchsorted(found, pair[here]), x[here], len(found))
    kept = np.flatnonzero(s >= need[i])
    return i[kept], j[kept], s[kept]


def _slices(query: np.ndarray, term: np.ndarray, qf: np.ndarray, n_queries: int, n_terms: int) -> list[tuple[int, int, tuple]]:
    """(first query, number, what _sums takes of them) of QUERY_ROWS queries at a time."""
    out = []
    for first in range(0, n_queries, QUERY_ROWS):
        m = min(QUERY_ROWS, n_queries - first)
        own = np.flatnonzero((query >= first) & (query < first + m))
        own = own[np.argsort(term[own], kind="stable")]
        out.append((first, m, (query[own] - first, term[own], qf[own], np.searchsorted(term[own], np.arange(n_terms + 1)))))
    return out


def _scanned(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, question: str, posted: DataFrame | None, k: int | None) -> DataFrame:
    """(query, doc, score): of every query and partition of the documents the k best scores, or all.

    The queries are cut into blocks of QUERY_BYTES by their measured number of terms; each goes to the
    tasks. A stored document has its postings in one row, so they are weighted and summed where they
    lie: nothing of the index is shuffled, and a pair of query and document is never a row.
    """
    posted = stored_index(docs, doc, text, True) if posted is None else posted
    spark = posted.sparkSession
    asked = queries.select(F.col(query).alias("query"), F.explode(tokens(F.col(question))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))
    if (terms := getattr(posted, "_rookery_terms", None)) is None:
        terms, asked = together(spark, lambda: materialise(_frequencies(posted)), lambda: materialise(asked))
        posted._rookery_terms = terms
    else:
        asked = materialise(asked)
    held = docs.agg(F.count("*").alias("n"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    corpus = terms.join(F.broadcast(held), how="inner").agg(F.max("n").alias("n"), (F.sum("cf") / F.max("n")).alias("avgdl"), (F.avg(raw) * EPSILON).alias("floor")).first()  # nulls without terms
    idf = terms.withColumn("n", F.lit(corpus.n).cast("long")).select("term", F.when(raw < 0, F.lit(corpus.floor)).otherwise(raw).alias("idf"))
    kinds = dict(posted.select("doc").dtypes) | dict(asked.select("query").dtypes)
    blocks = -(-asked.count() * TERM_BYTES // QUERY_BYTES) or 1

    def scan(block: DataFrame) -> DataFrame:
        table = block.join(idf, "term").select("query", "term", "qf", "idf").toArrow().combine_chunks()  # at most about QUERY_BYTES
        if table.num_rows:
            names, words = (table.column(c).combine_chunks().dictionary_encode("encode") for c in ("query", "term"))
            number = words.indices.to_numpy().astype(np.int64)
            sliced = _slices(names.indices.to_numpy(), number, table.column("qf").to_numpy().astype(np.float64), len(names.dictionary), len(words.dictionary))
            known = table.column("idf").to_numpy()[np.unique(number, return_index=True)[1]]
            shared = spark.sparkContext.broadcast((names.dictionary, sliced, words.dictionary, known))
        else:
            shared = spark.sparkContext.broadcast((None, [], pa.array([], pa.string()), np.empty(0)))

        def weighted(batches: Iterator[pa.RecordBatch], words: pa.Array, known: np.ndarray) -> Iterator[pa.RecordBatch]:
            """(doc, term, w) of the postings of known terms."""
            for batch in batches:
                terms = pa.compute.split_pattern(batch.column(1), " ")
                term = pa.compute.fill_null(pa.compute.index_in(terms.flatten(), value_set=words), -1).to_numpy()
                at = np.flatnonzero(term >= 0)
                row = pa.compute.list_parent_indices(terms).to_numpy()[at]
                term, tf, dl = term[at], _values(batch.column(2))[at], _values(batch.column(3))[at]
                w = known[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / corpus.avgdl))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(term), pa.array(w)], names=["doc", "t", "w"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, sliced, words, known = shared.value
            if names is None:
                return
            rows, pool, scores, bound = np.empty(0, np.int64), None, np.empty(0), np.full(len(names), np.inf)
            made = lambda rows, docs, scores: pa.RecordBatch.from_arrays([names.take(pa.array(rows)), docs, pa.array(scores)], names=["query", "doc", "score"])
            for ids, at, term, w in _whole_documents(weighted(batches, words, known)):
                n, base, usual = len(ids), len(rows), ((w > 1 / LARGE) & (w < LARGE)).all()
                found_rows, found_at, found = [rows], [np.arange(base)], [scores]
                for first, m, part in sliced:
                    if k is not None and usual and np.isinf(bound[first : first + m]).sum() * UNBOUND <= m:
                        i, j, s = _reaching(at, term, w, n, part, m, -bound[first : first + m] - 2e-9)
                        found_rows.append(i + first), found_at.append(j + base), found.append(-s)
                        continue
                    s = _sums(at, term, w, n, part, m)
                    meet = s > 0 if (w > 0).all() else _sums(at, term, np.ones(len(w)), n, (part[0], part[1], np.ones(len(part[2])), part[3]), m) > 0
                    if k is not None:
                        most = bound[first : first + m].copy()  # the k-th best so far, or of these documents
                        new = np.flatnonzero(np.isinf(most))
                        if len(new):
                            most[new] = np.partition(np.where(meet[new], -s[new], np.inf), min(k, n) - 1, axis=1)[:, min(k, n) - 1]
                        meet &= -s <= most[:, None] + 2e-9
                    i, j = np.nonzero(meet)
                    if k is None:
                        for low in range(0, len(i), POSTINGS):
                            part_i, part_j = i[low : low + POSTINGS], j[low : low + POSTINGS]
                            yield made(part_i + first, ids.take(pa.array(part_j)), s[part_i, part_j])
                    else:
                        found_rows.append(i + first), found_at.append(j + base), found.append(-s[i, j])
                if k is not None:
                    rows, place, scores = np.concatenate(found_rows), np.concatenate(found_at), np.concatenate(found)
                    pool = ids if pool is None else pa.concat_arrays([pool, ids])
                    order = pa.compute.rank(pool, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
                    kept = best(rows, order[place].astype(np.int64), scores, k)
                    rows, scores, pool = rows[kept], scores[kept], pool.take(pa.array(place[kept]))
                    full = np.flatnonzero(np.bincount(rows, minlength=len(names)) == k)
                    bound[full] = scores[np.searchsorted(rows, full, "right") - 1]
            if len(rows):
                yield made(rows, pool, -scores)

        return posted.select("doc", "terms", "tfs", "dls").mapInArrow(run, f"query {kinds['query']}, doc {kinds['doc']}, score double")

    if blocks == 1:
        return scan(asked)
    number = F.pmod(F.xxhash64("query"), F.lit(blocks))
    return functools.reduce(DataFrame.union, [scan(asked.where(number == b)) for b in range(blocks)])


def bm25_scores(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, question: str, posted: DataFrame | None = None) -> DataFrame:
    """(query, doc, score) of every document that shares a term with the query.

    posted is a stored_index() of docs; without one it is written here, once. Repeated query terms
    count each time; null and empty texts count as documents of length 0.
    """
    return _scanned(docs, doc, text, queries, query, question, posted, None)


def top_k(scores: DataFrame, k: int, by: str = "query", item: str = "doc", score: str = "score", decimals: int = 9) -> DataFrame:
    """(by, item, score, rank): the k best per `by`, rank from 0, ties (to `decimals`) by the lesser item."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round(score, decimals)), F.col(item))
    return scores.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select(by, item, score, "rank")


def bm25_best(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, question: str, k: int, posted: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank): what top_k leaves of bm25_scores, of which only each task's k best
    per query are kept on the way."""
    return top_k(_scanned(docs, doc, text, queries, query, question, posted, k), k)


def bm25_top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best per query, then those with a positive score."""
    return top_k(scores, k).where("score > 0")
