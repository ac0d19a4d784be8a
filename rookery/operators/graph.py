"""Knowledge graph: triples, linking, walks, retrieval, statistics.

Where the order of the original walk depended on set iteration, facts are ordered by
(hops, subject, relation, object, source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import normalise_entity, normalise_relation, parsed_object
from rookery.operators.components import connected_components
from rookery.session import materialise

MAX_NGRAM, MAX_FACTS, NEIGHBOUR_LIMIT, MAX_CHUNKS = 4, 24, 30, 4
# Words that never link alone.
STOPWORDS = (
    "the a an is are was what which who how when for of to in on at and or that this it do does should can i we long many much mean".split()
)


def extracted_triples(outputs: DataFrame, output: str, source: str) -> DataFrame:
    """(s, r, o, source) from a model's JSON {"triples": [{"s", "r", "o"}, ...]}.

    The object is found tolerantly; entries that aren't objects or lack a part are left out.
    """
    parsed = outputs.select(F.col(source).alias("source"), F.to_json(F.try_variant_get(parsed_object(F.col(output)), "$.triples", "variant")).alias("j"))
    entries = parsed.select("source", F.explode(F.from_json("j", "array<string>")).alias("e"))
    part = lambda name: F.coalesce(F.get_json_object("e", f"$.{name}"), F.lit(""))
    raw = entries.where("e like '{%'").select(part("s").alias("s"), part("r").alias("r"), part("o").alias("o"), "source")
    return raw.where("trim(s) <> '' and trim(r) <> '' and trim(o) <> ''").select(normalise_entity(F.col("s")).alias("s"), normalise_relation(F.col("r")).alias("r"), normalise_entity(F.col("o")).alias("o"), "source")


def build(triples: DataFrame) -> DataFrame:
    """The edge table (s, r, o, source): ends normalised again, relations untouched, parallel edges kept."""
    return triples.select(normalise_entity(F.col("s")).alias("s"), "r", normalise_entity(F.col("o")).alias("o"), "source")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("s").alias("node")).union(edges.select("o")).distinct()


def link_entities(questions: DataFrame, query: str, question: str, edges: DataFrame, max_ngram: int = MAX_NGRAM) -> DataFrame:
    """(query, node): nodes named by an n-gram of the question, without those inside a longer match."""
    words = questions.select(F.col(query).alias("query"), F.regexp_extract_all(normalise_entity(F.col(question)), F.lit("[a-z0-9.-]+"), F.lit(0)).alias("w"))
    def of_length(n: int):
        starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[of_length(n) for n in range(1, max_ngram + 1)]))
    named = words.select("query", F.explode(F.array_distinct(grams)).alias("node")).where(~((F.instr("node", " ") == 0) & (F.col("node").isin(STOPWORDS) | (F.length("node") < 3))))
    hits = named.join(nodes(edges), "node", "left_semi")
    longer = hits.select("query", F.col("node").alias("other"))
    inside = (hits["query"] == longer["query"]) & F.contains(longer["other"], hits["node"]) & (hits["node"] != longer["other"])
    return hits.join(longer, inside, "left_anti").select("query", "node")


def walk(starts: DataFrame, edges: DataFrame, hops: int = 2, limit: int = NEIGHBOUR_LIMIT) -> DataFrame:
    """(query, start, s, r, o, source, hops): edges within `hops` of each start, both directions.

    Edges count once per start by (s, r, o), at their least depth, with the least source; visited
    nodes aren't expanded again; a start that has `limit` edges after a depth stops, and each
    start's list is cut to `limit`. starts: (query, node). One pair of joins per hop.

    A start that goes on has found fewer than `limit` edges and takes `limit` more at most, in the
    order of (s, r, o), so of any node only the first 2 * limit edges in that order can matter. Hubs
    are cut to them before any join, and each depth to `limit` per start, which changes no result.
    """
    both = edges.select(F.col("s").alias("node"), "s", "r", "o", "source").union(edges.select("o", "s", "r", "o", "source"))
    once = both.groupBy("node", "s", "r", "o").agg(F.min("source").alias("source"))
    in_order = Window.partitionBy("node").orderBy("s", "r", "o")
    ends = materialise(once.withColumn("at", F.row_number().over(in_order)).where(F.col("at") <= 2 * limit).drop("at"))
    first = Window.partitionBy("query", "start").orderBy("s", "r", "o")
    seen_from = materialise(starts.select("query", F.col("node").alias("start"), "node").distinct().join(ends.select("node"), "node", "left_semi"))
    frontier, visited, found = seen_from, seen_from, None
    for depth in range(1, hops + 1):
        met = frontier.join(ends, "node").groupBy("query", "start", "s", "r", "o").agg(F.min("source").alias("source")).withColumn("hops", F.lit(depth))
        if found is not None:
            met = met.join(found, ["query", "start", "s", "r", "o"], "left_anti")
            full = found.groupBy("query", "start").agg(F.count("*").alias("c")).where(F.col("c") >= limit)
            met = met.join(full, ["query", "start"], "left_anti").select(found.columns)
        met = materialise(met.withColumn("at", F.row_number().over(first)).where(F.col("at") <= limit).drop("at"))
        found = met if found is None else found.union(met)
        if depth < hops:
            reached = met.select("query", "start", F.explode(F.array("s", "o")).alias("node")).distinct()
            frontier = reached.join(visited, ["query", "start", "node"], "left_anti").select("query", "start", "node")
            visited = visited.select("query", "start", "node").union(frontier)
    w = Window.partitionBy("query", "start").orderBy("hops", "s", "r", "o", "source")
    return found.withColumn("at", F.row_number().over(w)).where(F.col("at") <= limit).drop("at")


def retrieve_facts(walked: DataFrame, max_facts: int = MAX_FACTS) -> DataFrame:
    """(query, fact, source, hops, at): the first max_facts, closest first, across starts undeduplicated."""
    w = Window.partitionBy("query").orderBy("hops", "start", "s", "r", "o", "source")
    fact = F.concat("s", F.lit(" --"), "r", F.lit("--> "), "o")
    return walked.withColumn("at", F.row_number().over(w)).where(F.col("at") <= max_facts).select("query", fact.alias("fact"), "source", "hops", "at")


def retrieve_chunks(facts: DataFrame, chunks: DataFrame, chunk: str, body: str, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(query, chunk_id, source, facts, body): the chunks most facts cite, ties by first cited."""
    counts = facts.groupBy("query", F.col("source").alias("chunk_id")).agg(F.count("*").alias("facts"), F.min("at").alias("first"))
    w = Window.partitionBy("query").orderBy(F.desc("facts"), "first")
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_chunks)
    named = chunks.select(F.col(chunk).alias("chunk_id"), F.col(body).alias("body"))
    return top.join(named, "chunk_id").select("query", "chunk_id", F.concat(F.split_part("chunk_id", F.lit("::"), F.lit(1)), F.lit(".md")).alias("source"), "facts", "body")


def blocks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, n, body): one block of all facts first, then the chunks; a query without any abstains."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "fact"))), lambda x: x["fact"]), "\n")  # at most max_facts
    first = facts.groupBy("query").agg(listed.alias("body")).select("query", F.lit(1).alias("n"), "body")
    w = Window.partitionBy("query").orderBy(F.desc("facts"), "chunk_id")
    return first.union(chunks.select("query", (F.row_number().over(w) + 1).alias("n"), "body"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, triples, components, largest_component."""
    labels = connected_components(edges.select("s", "o"), "s", "o")
    sizes = labels.groupBy("component").agg(F.count("*").alias("c")).agg(F.count("*").alias("components"), F.coalesce(F.max("c"), F.lit(0)).alias("largest_component"))
    counts = edges.agg(F.count("*").alias("edges"), F.count("*").alias("triples"))
    held = nodes(edges).agg(F.count("*").alias("nodes"))
    return held.join(counts, how="inner").join(sizes, how="inner").select("nodes", "edges", "triples", "components", "largest_component")
