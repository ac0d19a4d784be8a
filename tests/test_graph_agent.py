import random

from pyspark.sql import functions as F

from rookery.operators import agent, graph
from rookery.operators.components import connected_components

EDGES = [("TLM-330", "handled_by", "safety desk", "c1::001"), ("safety desk", "part_of", "shed_mode's team", "c2::001"), ("shed mode team", "reports_to", "plant", "c3::002"), ("TLM-330", "handled_by", "safety desk", "c9::001")]


def edges(spark, rows=EDGES):
    return graph.build(spark.createDataFrame(rows, "s string, r string, o string, source string"))


def test_build_joins_variants(spark):
    assert {(r.s, r.o) for r in edges(spark).collect()} == {("tlm-330", "safety desk"), ("safety desk", "shed mode team"), ("shed mode team", "plant")}


def test_linking_prefers_longest(spark):
    q = spark.createDataFrame([(1, "Who handles TLM 330 at the safety desk?"), (2, "nothing here"), (3, None)], "qid int, question string")
    e = edges(spark, [*EDGES, ("safety", "x", "desk", "c")])
    assert {(r["query"], r.node) for r in graph.link_entities(q, "qid", "question", e).collect()} == {(1, "tlm-330"), (1, "safety desk")}


def test_walk_and_retrieval(spark):
    starts = spark.createDataFrame([(1, "tlm-330"), (2, "absent")], "query int, node string")
    one = graph.walk(starts, edges(spark), hops=1).collect()
    assert [(r.s, r.o, r.source, r.hops) for r in one] == [("tlm-330", "safety desk", "c1::001", 1)]
    two = graph.walk(starts, edges(spark), hops=2)
    assert sorted((r.hops, r.o) for r in two.collect()) == [(1, "safety desk"), (2, "shed mode team")]
    assert two.where("hops = 3").count() == 0
    facts = graph.retrieve_facts(two)
    assert facts.orderBy("at").first().fact == "tlm-330 --handled_by--> safety desk"
    chunks = spark.createDataFrame([("c1::001", "text one")], "id string, body string")
    got = graph.retrieve_chunks(facts, chunks, "id", "body").collect()
    assert [(r.chunk_id, r.source, r.facts) for r in got] == [("c1::001", "c1.md", 1)]
    blocks = graph.blocks(facts, graph.retrieve_chunks(facts, chunks, "id", "body")).orderBy("n").collect()
    assert [b.n for b in blocks] == [1, 2] and blocks[0].body.count("\n") == 1


def test_limit_stops_a_walk(spark):
    star = [("hub", "r", f"leaf{i:02d}", "c") for i in range(40)] + [("leaf00", "r", "far", "c")]
    got = graph.walk(spark.createDataFrame([(1, "hub")], "query int, node string"), edges(spark, star)).collect()
    assert len(got) == 30 and {r.hops for r in got} == {1}


def test_stats_and_components(spark):
    r = graph.stats(edges(spark, [*EDGES, ("a", "r", "b", "c")])).first()
    assert (r.nodes, r.edges, r.components, r.largest_component) == (6, 5, 2, 4)
    rng = random.Random(0)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_triples(spark):
    out = spark.createDataFrame([("c1", 'x {"triples": [{"s": "SEV 2", "r": "Is A", "o": "grade"}, 3, {"s": "", "r": "a", "o": "b"}, {"s": "q", "r": null, "o": "z"}]} y'), ("c2", "broken {"), ("c3", None)], "source string, output string")
    assert [tuple(r) for r in graph.extracted_triples(out, "output", "source").collect()] == [("sev2", "is_a", "grade", "c1")]


def test_action_parsing(spark):
    cases = [('{"action": "search", "query": " A "}', "search"), ('ok {"action": "answer", "text": "x [1]"} end', "answer"), ('{"action": "abstain", "reason": "r"}', "abstain"), ('{"action": "fly"}', "malformed"), ("[1, 2]", "malformed"), ("no json", "malformed"), ('{"action": "search"', "malformed"), (None, "malformed")]
    got = agent.parse_actions(spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, raw string"), "raw").orderBy("i").collect()
    assert [r.action for r in got] == [a for _, a in cases]
    assert got[0].query == "A" and got[1].answer == "x [1]" and got[5].raw_cut == "no json"


def test_replay(spark):
    s, a, x = (lambda q: '{"action": "search", "query": "%s"}' % q), (lambda t: '{"action": "answer", "text": "%s"}' % t), '{"action": "abstain", "reason": "none"}'
    logs = {"ok": [s("Alpha"), a("see [2]")], "repeat": [s("alpha"), s("ALPHA "), s("alpha"), s("beta"), a("late")], "bad": ["??", a("see [1]")], "stop": [x, s("alpha")], "many": [s("alpha"), s("beta"), a("[9]")]}
    rows = [(q, i + 1, raw) for q, log in logs.items() for i, raw in enumerate(log)]
    actions = agent.parse_actions(spark.createDataFrame(rows, "qid string, step int, raw string"), "raw")
    found = spark.createDataFrame([("alpha", c, i) for i, c in enumerate("abcd")] + [("beta", c, i) for i, c in enumerate("bce")], "query string, chunk_id string, rank int")
    got = {r.qid: r for r in agent.replay(actions, found).collect()}
    assert (got["ok"].answer, got["ok"].grounded, got["ok"].searches, got["ok"].n_blocks, got["ok"].llm_calls) == ("see [2]", True, 1, 3, 2)
    assert got["repeat"].stop_reason == "budget exhausted (4 steps)" and got["repeat"].searches == 2 and got["repeat"].abstained
    assert got["bad"].stop_reason == "answered (UNGROUNDED)" and got["bad"].n_blocks == 0
    assert got["stop"].answer == "NOT_FOUND: none" and got["stop"].llm_calls == 1
    assert got["many"].n_blocks == 4 and not got["many"].grounded
    lines = {r.qid: r.trajectory for r in agent.trajectory(actions).collect()}
    assert lines["ok"] == "1. search: Alpha\n2. answer: see [2]"


def test_run_asks_every_question_at_once(spark):
    q = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "never")], "qid int, question string")

    def model(df):
        answer = F.concat(F.lit('{"action": "answer", "text": "see [1] of '), F.length("evidence").cast("string"), F.lit('"}'))
        search = F.concat(F.lit('{"action": "search", "query": "'), "question", F.lit('"}'))
        return df.withColumn("raw", F.when(F.col("question") == "never", F.lit("??")).when(F.startswith("evidence", F.lit("(no")), search).otherwise(answer))

    def search(df):
        return df.withColumn("chunk_id", F.concat(F.lit("c-"), "query")).withColumn("rank", F.lit(0)).withColumn("source", F.lit("s.md")).withColumn("body", F.lit("text"))

    got = {r.qid: r for r in agent.run(q, model, search).collect()}
    assert got[1].grounded and got[1].n_blocks == 1 and got[1].llm_calls == 2 and got[2].stop_reason == "answered"
    assert got[3].stop_reason == "budget exhausted (4 steps)" and got[3].llm_calls == 4


def test_walk_cuts_hubs_without_changing_results(spark):
    """Against a plain walk in Python, on a graph whose hubs have far more edges than the limit."""
    import random
    from collections import defaultdict

    rng = random.Random(4)
    edges = [(f"n{i:03d}", "in", f"hub{i % 2}", f"c{rng.randint(1, 9)}") for i in range(160)] + [("hub0", "of", "top", "c1"), ("hub1", "of", "top", "c2")]
    edges += [(f"n{rng.randint(0, 159):03d}", "near", f"m{rng.randint(0, 30)}", f"c{rng.randint(1, 9)}") for _ in range(120)] + edges[:3]
    ends = defaultdict(set)
    for s, r, o, source in edges:
        ends[s].add((s, r, o, source)), ends[o].add((s, r, o, source))

    def plain(start, limit, hops):
        found, seen, frontier = {}, {start}, {start}
        for depth in range(1, hops + 1):
            if len(found) >= limit:
                break
            met = {}
            for node in frontier:
                for s, r, o, source in ends[node]:
                    if (s, r, o) not in found:
                        met[s, r, o] = min(met.get((s, r, o), source), source)
            found |= {k: (depth, v) for k, v in met.items()}
            frontier = {n for s, _, o in met for n in (s, o)} - seen
            seen |= frontier
        return sorted((d, *k, v) for k, (d, v) in found.items())[:limit]

    table = spark.createDataFrame(edges, "s string, r string, o string, source string")
    starts = spark.createDataFrame([(i, n) for i, n in enumerate(["n000", "n001", "m3", "hub0", "top", "nowhere"])], "query int, node string")
    for limit, hops in ((5, 2), (12, 3), (30, 2)):
        got = defaultdict(list)
        for r in graph.walk(starts, table, hops, limit).collect():
            got[r.start].append((r.hops, r.s, r.r, r.o, r.source))
        for node in ("n000", "n001", "m3", "hub0", "top", "nowhere"):
            assert sorted(got[node]) == plain(node, limit, hops), (node, limit, hops)
