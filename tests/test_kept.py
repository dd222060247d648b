"""Kept state: the staged drain behind ingest and the kept index, after crashes, edits and reruns."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import kg_payload, search
from tracelake.operators.kept_index import KeptIndex
from tracelake.streaming import stages


def plain(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


OUTPUTS = [("chunk", "chunks"), ("vector", "vectors"), ("entity", "entities"), ("entity", "relations"), ("name", "name_vectors")]


def tables(store):
    return {o: [repr(r) for r in plain(store.current(s, o))] for s, o in OUTPUTS}


def line(k, text, kind="user"):
    return json.dumps({"type": kind, "uuid": f"v{k}", "sessionId": "s1", "timestamp": f"2025-11-17T09:00:{k:02d}Z", "message": {"role": kind, "content": text}}) + "\n"


PARAGRAPH = "see src/app.py and MAX_RETRIES in DataLoader\nthen https://example.org/x for ConfigReader " + "word " * 30


def test_a_crash_between_stages_and_an_appended_file_end_like_one_run(spark, tmp_path, monkeypatch):
    logs, folder = tmp_path / "logs", tmp_path / "logs" / "-home-a"
    folder.mkdir(parents=True)
    (folder / "one.jsonl").write_text(line(1, PARAGRAPH + "\n\n" + "Second DataLoader part " * 60) + line(2, "an answer", "assistant") + line(3, "  "))
    (folder / "two.jsonl").write_text(line(4, "short one with DataLoader"))
    target = str(tmp_path / "lake")
    # the entity pass breaks after its outputs, before its log
    work = stages.entity_rows

    def broken(chunks):
        work(chunks)["entities"].write.mode("overwrite").parquet(f"{target}/stages/entity/out-entities/run=0")
        raise RuntimeError("cut off")

    monkeypatch.setattr(stages, "entity_rows", broken)
    with pytest.raises(RuntimeError):
        stages.catch_up(spark, str(logs), target, caps={"vector": 1})
    monkeypatch.setattr(stages, "entity_rows", work)
    store = stages.session_store(spark, target, caps={"entity": 1})
    assert store.runs("chunk") == [0] and store.runs("entity") == [] and store.current("entity", "entities").isEmpty()
    # no file has changed: the backlog is caught up, one chunk of the capped stage a run
    waves, needed = stages.catch_up(spark, str(logs), target, caps={"entity": 1})
    assert waves == [] and needed["chunk"] == 0 and needed["entity"] == store.output("chunk", "chunks").count() > 1
    assert {r.stage: r.n_eligible - r.n_done for r in store.progress().collect()} == dict.fromkeys(["chunk", "vector", "entity", "name"], 0)
    assert stages.catch_up(spark, str(logs), target) == ([], dict.fromkeys(["chunk", "vector", "entity", "name"], 0))
    # one file grows, the other loses its text
    (folder / "one.jsonl").write_text((folder / "one.jsonl").read_text() + line(5, "later EventStore"))
    (folder / "two.jsonl").write_text(line(4, "other text"))
    stages.catch_up(spark, str(logs), target)
    once = str(tmp_path / "once")
    stages.catch_up(spark, str(logs), once)
    assert tables(store) == tables(stages.session_store(spark, once))
    assert {r.name for r in store.current("name", "name_vectors").collect()} == {"src/app.py", "MAX_RETRIES", "DataLoader", "https://example.org/x", "ConfigReader", "EventStore"}
    assert store.output("chunk", "chunks").count() == store.current("chunk", "chunks").count() + 1


def test_nothing_to_drain(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    assert stages.catch_up(spark, str(tmp_path / "logs"), str(tmp_path / "lake")) == ([], {})


def test_relations_follow_the_lines(spark):
    chunks = spark.createDataFrame([(1, "a DataLoader in src/app.py twice: src/app.py\nMAX_RETRIES alone"), (2, None), (3, "none")], "chunk_id long, chunk string")
    assert [tuple(r) for r in kg_payload.line_relations(chunks).collect()] == [(1, "DataLoader", "src/app.py", "name_file")]


def test_kept_index_equals_the_scan_after_edits(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(12)] + ["Éte", "the"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))
    now = {k: text() for k in range(60)} | {60: None, 61: "", 62: "!!"}
    table = lambda rows: spark.createDataFrame(list(rows.items()), "doc long, body string")
    index = KeptIndex(spark, str(tmp_path / "index"), "doc")
    assert index.bm25("the", limit=5).collect() == []

    def same():
        for query in ("the", "w1 the", "w1 w2 ete", "absent", "w3 absent", ""):
            for where in (None, F.col("doc") % 2 == 0):
                scan = search.bm25(table(now), query, "doc", "body", limit=50, where=where)
                kept = index.bm25(query, limit=50, among=None if where is None else table(now).where(where))
                assert kept.collect() == scan.collect(), query
        assert sorted(r.doc for r in index.docs().collect()) == sorted(now)

    index.put(table(now).unionByName(table({3: now[3]})), "body")
    same()
    edits = {k: text() for k in (1, 2, 60, 100)}
    now |= edits
    for k in (5, 6):
        del now[k]
    index.put(table(edits), "body", removed=spark.createDataFrame([(5,), (6,), (999,)], "doc long"))
    same()
    # a segment that was cut off before its commit does not count, and is written again
    (tmp_path / "index" / "postings" / "segment=2" / "bucket=0").mkdir(parents=True)
    table({1: "x"}).selectExpr("'the' AS term", "doc", "9L AS tf", "1 AS length").write.mode("overwrite").parquet(f"{tmp_path}/index/postings/segment=2/bucket=0")
    same()
    now |= {1: "the the w1"}
    assert index.put(table({1: now[1]}), "body") == 2
    same()
    assert index.compact() == 3 and index.docs().where("segment < 3").isEmpty()
    same()
    hit = index.search(table(now), "w1 the", "body", limit=3).collect()
    assert [r.doc for r in hit] == [r.doc for r in index.bm25("w1 the", limit=3).collect()] and all("<mark>" in r.snippet for r in hit)


def test_tasks_of_the_index_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """However few shuffle partitions are set, no task counts or sorts more than about so many words."""
    from tracelake.operators import kept_index

    monkeypatch.setattr(kept_index, "TASK_WORDS", 50, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        texts = spark.createDataFrame([(k, f"alpha beta w{k % 7} " * 3) for k in range(100)], "doc long, body string")
        index = KeptIndex(spark, str(tmp_path / "index"), "doc")
        for segment in (index.put(texts, "body"), index.compact()):
            files = list((tmp_path / "index" / "postings" / f"segment={segment}" / f"bucket={kept_index._bucket_of('')}").glob("*.parquet"))
            assert len(files) > 3
        assert index.bm25("alpha w3", limit=5).collect() == search.bm25(texts, "alpha w3", "doc", "body", limit=5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_search_reads_its_terms_buckets_only(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "index"), "doc")
    index.put(spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc long, body string"), "body")
    plan = index.bm25("alpha")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("PushedFilters", 1)[0]


def test_excerpts_of_every_scope(spark):
    from datetime import datetime

    from tracelake.operators import claims

    at = lambda day, hour: datetime(2025, 11, day, hour)
    rows = [("p", "human", at(17, h), f"text {h}") for h in range(22)] + [("p", "human", at(24, 1), "next week"), ("p", "assistant_text", at(17, 23), "no"), ("p", "human", None, "no"), ("p", "human", at(17, 23), None), ("lost", "human", at(17, 23), "no"), ("q", "human", at(17, 21), "longer text 21")]
    events = spark.createDataFrame(rows, "project_id string, msg_kind string, ts timestamp, message_content string")
    scopes = spark.createDataFrame([("p", "a/b"), ("q", "a"), ("lost", None)], "project_id string, scope string")
    got = {}
    for r in claims.excerpts(claims.excerpt_candidates(events, scopes, "week")).orderBy("rank").collect():
        got.setdefault((r.scope, r.bucket), []).append(r.text)
    latest = [f"text {h}" for h in range(21, 0, -1)]
    assert got == {("", "2025-11-17"): ["longer text 21", *latest][:20], ("a", "2025-11-17"): ["longer text 21", *latest][:20], ("a/b", "2025-11-17"): latest[:20], ("", "2025-11-24"): ["next week"], ("a", "2025-11-24"): ["next week"], ("a/b", "2025-11-24"): ["next week"]}
