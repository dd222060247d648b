"""Claim taxonomies and the readers, on small tables with known results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import claim_clusters, claims, readers

FAMILIES = {"database": ["index", "query", "table", "schema", "lock", "page"], "network": ["socket", "packet", "router", "port", "proxy", "cable"], "garden": ["rose", "spade", "fence", "lawn", "hedge", "pond"]}


def _claims(spark):
    rows = [("p", f"s{n % 3}", "tasks", f"{head} {head} {head}  {tail.upper()}") for head, tails in FAMILIES.items() for n, tail in enumerate(tails)]
    rows += [("p", "s0", "learnings", "One thing"), ("p", "s1", "learnings", "one  THING"), ("p", "s1", "learnings", "another"), ("p", "s2", "learnings", "  "), ("p", "s2", None, "no lens"), ("p", "s2", "learnings", None)]
    return spark.createDataFrame(rows, "project_id string, session_id string, lens string, claim string")


def test_concepts_are_embedded_once(spark):
    found = claim_clusters.concepts(_claims(spark))
    assert found.where("lens = 'tasks'").count() == 18
    assert sorted(r.concept for r in found.where("lens = 'learnings'").collect()) == ["another", "one thing"]
    assert found.where("lens IS NULL").count() == 0


def test_taxonomy_of_all_lenses(spark):
    made = claim_clusters.cluster_claims(_claims(spark))
    meta = {r.lens: r for r in made.meta.collect()}
    assert meta["learnings"].used_singleton and meta["learnings"].n_layers == 1 and meta["learnings"].n_concepts == 2
    assert not meta["tasks"].used_singleton and meta["tasks"].n_layers == 2 and meta["tasks"].n_concepts == 18
    # every concept once in every layer
    sizes = made.membership.groupBy("lens", "layer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("concept").alias("d")).collect()
    assert {(r.lens, r.layer): (r.n, r.d) for r in sizes} == {("learnings", 0): (2, 2), ("tasks", 0): (18, 18), ("tasks", 1): (18, 18)}
    # the families stay apart in the finest layer
    fine = made.membership.where("lens = 'tasks' AND layer = 0").collect()
    heads: dict[int, set[str]] = {}
    for r in fine:
        heads.setdefault(r.cluster_id, set()).add(r.concept.split()[0])
    assert all(len(h) == 1 for c, h in heads.items() if c >= 0)
    # parents are those that most members are in
    labels = {(r.layer, r.concept): r.cluster_id for r in made.membership.where("lens = 'tasks'").collect()}
    for r in made.clusters.where("lens = 'tasks' AND layer = 0 AND cluster_id >= 0").collect():
        above = [labels[1, c] for (layer, c), k in labels.items() if layer == 0 and k == r.cluster_id and labels[1, c] >= 0]
        assert r.parent_id == min(set(above), key=lambda c: (-above.count(c), c))


def test_no_claims_make_an_empty_taxonomy(spark):
    made = claim_clusters.cluster_claims(_claims(spark).limit(0))
    assert made.membership.count() == made.clusters.count() == made.meta.count() == 0


def test_names_are_kept_while_members_stay(spark):
    rows = _claims(spark)
    made = claim_clusters.cluster_claims(rows)
    first = claim_clusters.name_clusters(made, rows)
    known = {(r.lens, r.layer, r.cluster_id): r.name for r in first.collect()}
    assert all(r.fresh for r in first.collect()) and {k[0] for k in known} == {"tasks", "learnings"}
    again = claim_clusters.name_clusters(made, rows, lambda lens, texts: '{"name": "new"}', first.drop("fresh")).collect()
    assert {(r.lens, r.layer, r.cluster_id): r.name for r in again} == known and not any(r.fresh for r in again)
    # another spelling of a member changes its cluster's texts, and that one alone
    more = rows.unionByName(spark.createDataFrame([("p", "s9", "learnings", "ANOTHER")], rows.schema))
    fresh = [r for r in claim_clusters.name_clusters(made, more, lambda lens, texts: '{"name": "new"}', first.drop("fresh")).collect() if r.fresh]
    assert [(r.lens, r.name) for r in fresh] == [("learnings", "new")]


def test_tree_of_tagged_leaves_keeps_every_claim(spark):
    rows = _claims(spark)
    events = spark.createDataFrame([("p", f"s{n}", f"2024-01-0{n + 1} 10:00:00") for n in range(3)], "project_id string, session_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    scopes = spark.createDataFrame([("p", "a/p")], "project_id string, scope string")
    taxonomy, names, rollups = claim_clusters.claim_pipeline(rows, events, scopes, grains=("day", "month"))
    assert {r.grain for r in rollups.select("grain").distinct().collect()} == {"day", "month"}
    root = rollups.where("grain = 'month' AND scope = ''")
    assert root.where("lens = 'tasks'").count() == 18
    assert root.where("claim = 'one thing'").first().n_sessions == 2
    tree = claims.cluster_tree(claim_clusters.tree_leaves(root, taxonomy, names))
    assert {r.lens: r.n for r in tree.groupBy("lens").agg(F.sum("n_leaves").alias("n")).collect()} == {"tasks": 18, "learnings": 2}


def test_leaves_without_a_tag_are_noise(spark):
    leaves = spark.createDataFrame([("tasks", "known", 1), ("tasks", "unknown", 1)], "lens string, claim string, n_sessions int")
    tags = spark.createDataFrame([("tasks", "known", 7)], "lens string, claim string, cluster_id int")
    assert {r.claim: r.cluster_id for r in claim_clusters.tagged(leaves, tags).collect()} == {"known": 7, "unknown": -1}


def test_readers(spark):
    scopes = spark.createDataFrame([("p1", "a/b/p1"), ("p2", "a/c"), ("p3", "d")], "project_id string, scope string")
    assert sorted(tuple(r) for r in readers.scope_children(scopes, "").collect()) == [("a", 1), ("d", 1)]
    assert sorted(tuple(r) for r in readers.scope_children(scopes, "a").collect()) == [("a/b", 2), ("a/c", 2)]
    active = spark.createDataFrame([("p2",)], "project_id string")
    assert [tuple(r) for r in readers.scope_children(scopes, "a", active).collect()] == [("a/c", 2)]
    assert readers.project_scope(scopes, "p1").first().ancestors == ["", "a", "a/b", "a/b/p1"]
    assert readers.project_scope(scopes, "none").count() == 0
    failures = spark.createDataFrame([("p1", "s1", "m1"), ("p1", "s1", "m1"), ("p3", "s3", "m2")], "project_id string, session_id string, model string")
    buckets = spark.createDataFrame([("p1", "s1", "2024-01"), ("p3", "s3", "2024-02")], "project_id string, session_id string, bucket string")
    assert [tuple(r) for r in readers.failed_sessions(failures, buckets, scopes, "a").collect()] == [("p1", "s1")]
    assert readers.failed_sessions(failures, buckets, scopes, "").count() == 2
    assert readers.failed_sessions(failures, buckets, scopes, "", "2024-02").count() == 1
    found = spark.createDataFrame([("p1", "s1", "m3")], failures.schema)
    assert {r.model for r in readers.session_claim_models(found, failures, "p1", "s1").collect()} == {"m1", "m3"}
    rollups = spark.createDataFrame([("a", "day", "x", "strict", "m"), ("a", "day", "x", "flat", "m")], "scope string, grain string, bucket string, strategy string, model string")
    assert readers.rollup_summary(rollups, "a", "day", "x").count() == 2
    assert readers.rollup_summary(rollups, "a", "day", "x", strategy="flat").count() == 1
    assert readers.variants(rollups).count() == 2


def test_pipeline_stages(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "files": t([("a",), ("b",)], "f string"),
        "source_files": t([("a",)], "f string"),
        "events": t([(1, "human", "x"), (2, "human", ""), (3, "human", "y"), (4, "other", "z"), (5, "human", None)], "event_id int, msg_kind string, message_content string"),
        "chunks": t([(1,), (1,), (9,)], "event_id int"),
        "vectors": t([(n,) for n in range(5)], "v int"),
        "ner_log": t([(1,)], "c int"),
        "re_log": t([], "c int"),
        "entities": t([("u",), ("u",), ("v",)], "name string"),
        "entity_vectors": t([("u",)], "name string"),
        "entity_clusters": t([("u",)], "name string"),
        "communities": t([(0.25, "u", 1), (3.0, "u", 1), (3.0, "v", 2)], "resolution double, node string, community int"),
        "labels": t([(3.0,), (3.0,)], "resolution double"),
    }
    got = {r.stage: (r.eligible, r.done, r.pending, r.pct) for r in readers.pipeline_stages(tables).collect()}
    assert got == {
        "ingest": (2, 1, 1, 50.0), "chunk": (2, 1, 1, 50.0), "embed": (3, 3, 0, 100.0), "ner": (3, 1, 2, 33.3), "re": (3, 0, 3, 0.0),
        "entity_embed": (2, 1, 1, 50.0), "resolve": (1, 1, 0, 100.0), "communities": (1, 1, 0, 100.0), "naming": (1, 0, 1, 0.0),
    }
    empty = {k: d.limit(0) for k, d in tables.items()}
    assert {(r.eligible, r.done, r.pct) for r in readers.pipeline_stages(empty).collect()} == {(0, 0, 0.0)}
