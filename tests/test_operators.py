from __future__ import annotations

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import claims, graph, incremental, schema_timeline, search, text_metrics, timing, trees


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


TWO_CLIQUES = [*itertools.combinations("abcd", 2), *itertools.combinations("wxyz", 2), ("d", "w")]


def test_graph_measures(spark):
    g = edges(spark, [*TWO_CLIQUES, ("a", "a"), ("b", "a"), ("p", "q")])
    assert {r.node: r.degree for r in graph.degrees(g).collect()} == {"a": 3, "b": 3, "c": 3, "d": 4, "w": 4, "x": 3, "y": 3, "z": 3, "p": 1, "q": 1}
    reached = graph.neighbourhood(g, spark.createDataFrame([("a",)], "node string"), 2)
    assert {r.node: r.depth for r in reached.collect()} == {"a": 0, "b": 1, "c": 1, "d": 1, "w": 2}
    assert graph.neighbourhood(g, spark.createDataFrame([("a",)], "node string")).count() == 8
    assert {r.node: r.component for r in graph.components(g).collect()} == dict.fromkeys("abcdwxyz", "a") | dict.fromkeys("pq", "p")
    assert graph.k_core(g, 3).count() == 13 and graph.k_core(g, 4).count() == 0


def test_communities(spark):
    found = {r.node: r.community for r in graph.communities(edges(spark, TWO_CLIQUES)).collect()}
    assert len({found[n] for n in "abcd"}) == 1 and len({found[n] for n in "wxyz"}) == 1 and found["a"] != found["z"]


def test_betweenness(spark):
    score = {(r.src, r.dst): r.score for r in graph.betweenness(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])).collect()}
    assert score[("b", None)] == score[("c", None)] == 2 and score[("b", "c")] == 4 and score[("a", "b")] == 3


def test_resolution(spark):
    names = spark.createDataFrame([("Postgres SQL", 2), ("PostgreSQL", 5), ("Postgresql", 1), ("Redis", 3)], "name string, mentions long")
    canonical = graph.resolve(names, graph.similar_names(names, most=0.3))
    assert {r.name: r.canonical for r in canonical.collect()} == {"Postgres SQL": "PostgreSQL", "PostgreSQL": "PostgreSQL", "Postgresql": "PostgreSQL", "Redis": "Redis"}
    assert {r.node: r.mentions for r in graph.rolled_nodes(names, canonical).collect()} == {"PostgreSQL": 8, "Redis": 3}
    relations = spark.createDataFrame([("Postgresql", "Redis", "uses", 1.0), ("PostgreSQL", "Redis", "uses", 2.0), ("Postgresql", "PostgreSQL", "is", 1.0)], "src string, dst string, rel_type string, weight double")
    assert [tuple(r) for r in graph.rolled_edges(relations, canonical).collect()] == [("PostgreSQL", "Redis", "uses", 3.0)]


def test_similar_names_finds_all_pairs_of_a_block(spark):
    rng = random.Random(5)
    names = sorted({f"cluster {rng.choice('abcd')}{rng.randrange(40):02d} {rng.choice(['node', 'nodes', 'gateway'])}" for _ in range(60)} | {"Cluster a01 node", "x", "", "clu"})
    pairs = lambda t: {t[i : i + 2] for i in range(max(1, len(t) - 1))}

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    def alike(a, b):
        a, b = a.lower(), b.lower()
        blocks = lambda t: {t[:3], *(w for w in t.split() if len(w) > 3)}
        if not blocks(a) & blocks(b):
            return False
        shared = len(pairs(a) & pairs(b)) / len(pairs(a) | pairs(b))
        return 1 - round(0.3 * (1 - edit(a, b) / max(len(a), len(b))) + 0.7 * shared, 6) <= 0.2

    want = {(a, b) for a, b in itertools.combinations(names, 2) if alike(a, b)}
    got = [(r.a, r.b) for r in graph.similar_names(spark.createDataFrame([(n,) for n in [*names, *names[:5], None]], "name string"), most=0.2).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_community_levels(spark):
    rows = graph.community_levels(edges(spark, TWO_CLIQUES), (0.25, 1.0)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.resolution, {})[r.node] = (r.community, r.modularity)
    assert {len({c for c, _ in level.values()}) for level in by.values()} == {2} or len({c for c, _ in by[0.25].values()}) == 1
    for resolution, level in by.items():
        adjacent = {frozenset(e) for e in TWO_CLIQUES}
        degree = {n: sum(n in e for e in adjacent) for n in level}
        inside = sum(2 for e in adjacent if len({level[n][0] for n in e}) == 1) / (2 * len(adjacent))
        totals = [sum(degree[n] for n in level if level[n][0] == c) for c in {c for c, _ in level.values()}]
        quality = inside - resolution * sum(t * t for t in totals) / (2 * len(adjacent)) ** 2
        assert all(abs(q - quality) < 1e-6 for _, q in level.values())
    empty = spark.createDataFrame([], "src string, dst string, weight double")
    assert graph.communities(empty).count() == 0


def test_key_paths_at_any_depth(spark):
    deep = '{"a":' * 12 + "[1, {\"z\": null}]" + "}" * 12
    raws = spark.createDataFrame([("1", deep), ("2", "[]"), ("3", "7")], "record string, text string").select("record", F.parse_json("text").alias("raw"))
    got = {(r.record, r.path) for r in schema_timeline.key_paths(raws).collect()}
    chain = ["$" + ".a" * n for n in range(1, 13)]
    assert got == {("1", p) for p in [*chain, chain[-1] + "[]", chain[-1] + "[].z"]}


def test_session_order_over_ranges(spark):
    rows = [(f"s{i:02d}", f"2026-01-{1 + i % 7:02d} 00:00:00", i) for i in range(40)]
    got = timing.session_order(spark.createDataFrame([*rows, *rows[:3]], "session_id string, session_start string, running_output long")).collect()
    want = sorted((start, session) for session, start, _ in rows)
    assert {(r.session_start, r.session_id): r.place for r in got} == {k: n for n, k in enumerate(want, 1)}
    assert timing.session_order(spark.createDataFrame([], "session_id string, session_start string, running_output long")).count() == 0


def test_descendants_survive_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent long, child long")
    got = trees.descendants(links, spark.createDataFrame([(1,)], "node long"))
    assert {r.node: r.depth for r in got.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_chunks(spark):
    texts = ["short", "\n\n".join(["a" * 200, "b" * 200]), "\n\n".join([c * 400 for c in "abcdefghij"]), "\n\n".join(["a" * 1190, "tail"]), "", None]
    rows = search.chunks(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.id, r.nth)):
        by.setdefault(r.id, []).append(r)
    assert [len(by.get(k, [])) for k in range(6)] == [1, 1, 5, 1, 0, 0]
    assert by[3][0].chunk.endswith("\n\ntail") and all(len(r.chunk) <= 1200 for r in by[2])
    assert [r.offset for r in by[2]] == [0, 804, 1608, 2412, 3216]


def test_keyword_search(spark):
    docs = spark.createDataFrame([(1, "Café noir"), (2, "cafe cafe au lait"), (3, "tea"), (4, None)], "id long, text string")
    assert {r.id for r in search.bm25(docs, "cafe", "id", "text").collect()} == {1, 2}
    assert search.bm25(docs, "  ", "id", "text").count() == 0
    assert [r.id for r in search.bm25(docs, "cafe lait", "id", "text").collect()] == [2]
    assert docs.where("id = 2").select(search.snippet(F.col("text"), "au").alias("s")).first().s == "cafe cafe <mark>au</mark> lait"
    assert {r.term: r.tf for r in search.postings(docs, "id", "text").where("id = 2").collect()} == {"cafe": 2, "au": 1, "lait": 1}


def test_vectors(spark):
    texts = spark.createDataFrame([(1, "red blue green"), (2, "red blue yellow"), (3, "one two three")], "id long, text string")
    vectors = search.embed(texts, "id", "text")
    query = [float(x) for x in search.hashing_embedder(["red blue green"])[0]]
    got = search.nearest(vectors, query, "id", "embedding").collect()
    assert [r.id for r in got] == [1, 2, 3] and got[0].distance == pytest.approx(0, abs=1e-6)


def test_text_scores():
    rng = random.Random(1)
    same = text_metrics.score("a b c d e", "a b c d e")
    assert same["rouge_l"] == same["bleu"] == same["f1"] == 1.0
    assert text_metrics.score("x y", "a b")["f1"] == 0.0 and text_metrics.score(None, "a")["rouge_l"] == 0.0
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert text_metrics.common_subsequence(a, b) == table[-1][-1]


def test_layers_and_parents(spark):
    assert [claims.select_layers(n, p) for n, p in ((1, [0.0]), (3, [0.2, 0.9, 0.1]), (3, [0.2, 0.1, 0.9]), (2, [0.9, 0.1]))] == [(0, 0), (2, 1), (2, 1), (1, 0)]
    members = spark.createDataFrame([(0, 5), (0, 4), (0, 4), (1, 3), (1, 2), (2, -1), (-1, 2)], "fine int, coarse int")
    assert {r.fine: r.coarse for r in claims.plurality_parents(members).collect()} == {0: 4, 1: 2, 2: None}


def test_claim_rollup_ranks(spark):
    rows = [("p", "s1", "goals", " Refactor  makefile"), ("p", "s2", "goals", "refactor makefile"), ("p", "s1", "goals", "add tests")]
    made = spark.createDataFrame(rows, "project_id string, session_id string, lens string, claim string")
    buckets = spark.createDataFrame([("p", "s1", "w1"), ("p", "s2", "w2")], "project_id string, session_id string, bucket string")
    scopes = spark.createDataFrame([("p", "a/b")], "project_id string, scope string")
    union = {(r.scope, r.claim): r.n_sessions for r in claims.claim_union(claims.claim_rollup(made, buckets, scopes)).collect()}
    assert union[("", "refactor makefile")] == 2 and union[("a/b", "add tests")] == 1


def test_replacement_and_latency(spark):
    old = spark.createDataFrame([("f1", 1), ("f2", 2)], "file_path string, v long")
    new = spark.createDataFrame([("f2", 3)], "file_path string, v long")
    assert sorted(r.v for r in incremental.replaced_by_file(old, new).collect()) == [1, 3]
    calls = spark.createDataFrame([("e", float(k)) for k in range(1, 101)], "endpoint string, ms double")
    r = incremental.latency_table(calls, "endpoint", "ms").first()
    assert (r.p50, r.p95, r.p99, r.max_ms) == (51, 96, 100, 100)


def test_refreshed_cube_shuffles_no_events_by_month(spark):
    """Events of a month are not gathered by it: buckets of time go to the rows."""
    from tracelake.operators import usage

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [(datetime.datetime(2025, 1 + k % 3, 1 + k % 28, k % 24), "p", f"s{k % 5}", "m", k, 1, 1, 1, 0.5) for k in range(300)]
        events = spark.createDataFrame(rows, "ts timestamp, project_id string, session_id string, model_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, cost_usd double")
        late = F.col("ts") >= "2025-03-05"
        got = usage.refreshed_cube(usage.cube(events.where(~late)), events, events.where(late))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, usage.cube(events).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_embedder_gets_few_texts_at_once(spark):
    """A batch of Arrow rows is not embedded at once."""
    from tracelake.operators import search

    texts = spark.range(3000).coalesce(1).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))

    def counting(batch):
        assert len(batch) <= 256
        return search.hashing_embedder(batch, 8)

    got = {r.id: list(r.embedding) for r in search.embed(texts, "id", "text", counting).collect()}
    want = search.hashing_embedder([f"text {k}" for k in range(3000)], 8)
    assert len(got) == 3000 and all(got[k] == want[k].tolist() for k in range(3000))
    assert search.embed(texts.limit(0), "id", "text").count() == 0
