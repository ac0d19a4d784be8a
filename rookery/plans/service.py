"""The service surface as a library: search, ask, documents, triage, comparison."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions import seams
from rookery.functions.text import approx_tokens, outline, parsed_object
from rookery.operators import dense, evaluation, fusion, lexical
from rookery.session import materialise, together
from rookery.sources.index_store import IndexStore
from rookery.sources.readers import read_document

def clamp(k: int, low: int = 1, high: int = 12) -> int:
    return max(low, min(k, high))


@dataclass
class Engine:
    """Search over chunks (id, body, source, breadcrumb, embedding) for batches of questions (qid, question)."""

    chunks: DataFrame
    generate: Callable[[DataFrame], DataFrame] | None = None
    candidates: int = fusion.CANDIDATES

    @functools.cached_property
    def _postings(self) -> DataFrame:
        """The lexical index, written on first need and used by every later search."""
        return lexical.stored_index(self.chunks, "id", "body", True)

    def _arms(self, questions: DataFrame, mode: str) -> tuple[DataFrame | None, DataFrame | None]:
        """The arms that a mode needs, each with `candidates` a question. Two are searched at the same time
        and stored: their fusion would else be planned with the partitions of the searches, far too many for so few rows."""
        asked = questions.where("length(question) >= 3")
        needs_dense, needs_lexical = fusion.arms_of(mode)

        def near() -> DataFrame:
            return dense.exact_top_k(self.chunks, "id", "embedding", asked.withColumn("qv", seams.embed()(F.col("question"))), "qid", "qv", self.candidates)

        def best() -> DataFrame:
            found = lexical.bm25_best(self.chunks, "id", "body", asked, "qid", "question", self.candidates, self._postings)
            return found.where("score > 0").withColumnRenamed("doc", "item")

        if needs_dense and needs_lexical:
            return tuple(together(self.chunks.sparkSession, lambda: materialise(near()), lambda: materialise(best())))
        return near() if needs_dense else None, best() if needs_lexical else None

    def search(self, questions: DataFrame, mode: str = "hybrid", top_k: int = 4, rerank: bool = True, arms: tuple | None = None) -> DataFrame:
        """(query, item, rank, rrf_score, dense_rank, bm25_rank, body, source, breadcrumb); questions
        under three characters are left out; top_k is held within 1..12. arms: those of an earlier search."""
        k = clamp(top_k)
        asked = questions.where("length(question) >= 3")
        arm_d, arm_l = arms or self._arms(questions, mode)
        payload = self.chunks.select(F.col("id").alias("item"), "body", "source", "breadcrumb")
        words = asked.select(F.col("qid").alias("query"), "question")

        def second(hits: DataFrame) -> DataFrame:
            """Questions join where the hits lie, and only scores are ranked: bodies of all candidates are never shuffled by question."""
            full = hits.join(words, "query").join(payload.select("item", "body"), "item")
            scored = full.withColumn("rerank_score", seams.overlap_score(F.col("question"), F.col("body"))).drop("question", "body")
            return fusion.rerank(scored, F.col("rerank_score"), k)

        return fusion.retrieve(mode, arm_d, arm_l, k, second if rerank else None, self.candidates).join(payload, "item")

    def ask(self, questions: DataFrame, mode: str = "hybrid", top_k: int = 4) -> DataFrame:
        """Contexts, the generator's text, its verified citations and the cited sources."""
        return self._answered(questions, fusion.context_blocks(self.search(questions, mode, clamp(top_k, 1, 10)), "query", "rank", "source", "body"))

    def _answered(self, questions: DataFrame, blocks: DataFrame) -> DataFrame:
        asked = questions.select(F.col("qid").alias("query"), "question").join(blocks, "query", "left")
        if self.generate is None:
            raise ValueError("no generator: pass generate=, a function of (query, question, context, n_blocks) that adds text")
        return fusion.verified(self.generate(asked.na.fill(0, ["n_blocks"])), "text", "n_blocks")

    def compare(self, questions: DataFrame, top_k: int = 4) -> DataFrame:
        """The modes side by side, with a label."""
        arms = self._arms(questions, "hybrid")  # each is read by two modes
        parts = [self.search(questions, mode, top_k, rerank=False, arms=arms).select(F.lit(mode).alias("mode"), "query", "rank", "item", "source") for mode in ("dense", "bm25", "hybrid")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def ask_stream(self, questions: DataFrame, mode: str = "hybrid", top_k: int = 4) -> DataFrame:
        """(query, seq, event, data) in the order a stream sends them: the sources, each token of the
        text, and at last an audit of its citations as JSON."""
        k = clamp(top_k)
        listed = F.array_sort(F.collect_list(F.struct((F.col("rank") + 1).alias("n"), "item", "source", "breadcrumb")))  # at most top_k
        hits = self.search(questions, mode, k)
        blocks = materialise(fusion.context_blocks(hits, "query", "rank", "source", "body", F.to_json(listed).alias("sources")))  # read for the answer and for the sources
        told = self._answered(questions, blocks.drop("sources")).join(blocks.select("query", "sources"), "query", "left")
        audit = F.to_json(F.struct("citations", F.col("invalid").alias("invalid_citations"), "abstained", "grounded"))
        row = lambda event, data: F.struct(F.lit(event).alias("event"), data.alias("data"))
        tokens = F.transform(F.regexp_extract_all("text", F.lit(r"\s*\S+|\s+$"), F.lit(0)), lambda t: row("token", F.to_json(F.struct(t.alias("t")))))
        events = F.concat(F.array(row("sources", F.coalesce("sources", F.lit("[]")))), F.coalesce(tokens, F.array().cast("array<struct<event: string, data: string>>")), F.array(row("done", audit)))
        return told.select("query", F.posexplode(events).alias("seq", "e")).select("query", "seq", "e.event", "e.data")

    def triage(self, reports: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(qid, component, severity, error_code, page_oncall, action, error, raw) of reports (qid, report).
        model adds raw, its output; where that isn't a JSON object the fields are null and error says so."""
        said = model(reports.select("qid", "report")).withColumn("__o", parsed_object(F.col("raw")))
        field = lambda f: F.try_variant_get("__o", f"$.{f}", "boolean" if f == "page_oncall" else "string").alias(f)
        return said.select("qid", *[field(f) for f in evaluation.FIELDS], F.when(F.col("__o").isNull(), "model did not return valid JSON").alias("error"), "raw")

    def health(self) -> DataFrame:
        return self.chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("source").alias("n_sources"), F.sum(approx_tokens(F.col("body"))).alias("approx_tokens"))


def list_documents(corpus: DataFrame) -> DataFrame:
    """(file, title, sections, n_bytes) of (file, text)."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return corpus.select("file", outline(F.col("text"), stem).alias("o")).select("file", "o.*")


def document(root: str, name: str) -> str:
    return read_document(root, name)


def index_stats(store: IndexStore, corpus: DataFrame) -> DataFrame:
    """One row (status, shards, n_chunks, text_chars, model, dim, documents): 'not built' before the
    first commit. Read from the manifest alone, but for the number of documents."""
    held = store.manifest().agg(F.max("model").alias("model"), F.max("dim").alias("dim"))
    documents = corpus.agg(F.count("*").alias("documents"))
    status = F.when(F.col("shards") > 0, "ok").otherwise("not built")
    return store.totals().join(held, how="inner").join(documents, how="inner").select(status.alias("status"), "shards", "n_chunks", "text_chars", "model", "dim", "documents")


def triage_prompt(report: str) -> str:
    """The prompt that leads an agent from a report to its runbook."""
    return (
        f"This incident was reported:\n\n{report}\n\nFirst get its structured record with the triage tool. Then ask for the runbook of that "
        "component and severity. Then say what is broken, how severe it is, whether to page on-call, and the steps to take, citing the documents used. "
        "Where the documents don't cover it, say that."
    )
