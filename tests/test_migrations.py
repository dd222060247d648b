"""The one-shot pruning of repeated events: against plain Python, cut off and run again."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelake.sources import tables as T
from tracelake.streaming import migrations

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lake(spark):
    """Events of few sessions and uuids, nulls among them, and what hangs on them."""
    rng = random.Random(3)
    rows = [(k, rng.choice(["s1", "s2", None]), rng.choice([None, *map(str, range(40))]), f"f{rng.randrange(60)}") for k in range(300)]
    facts = T.session_events(spark, DATA).drop("event_key", "session_id").limit(1)
    events = spark.createDataFrame(rows, "event_key long, session_id string, event_uuid string, source_file string").join(F.broadcast(facts), how="cross")
    edges = [(k, "p", rng.choice(["s1", None]), rng.choice([None, "a", "b"]), rng.choice([None, "a", "c"]), f"f{rng.randrange(80)}") for k in range(60)]
    chunks = [(1000 + k, k) for k in range(0, 300, 2)]
    tables = {
        "events": events,
        "calls": spark.createDataFrame([(k, "x") for k in range(0, 300, 3)], "event_key long, call string"),
        "chunks": spark.createDataFrame(chunks, "chunk_key long, event_key long"),
        "edges": spark.createDataFrame(edges, "edge_key long, project_id string, session_id string, event_uuid string, parent_uuid string, source_file string"),
        "files": spark.createDataFrame([(f"f{k}",) for k in range(90)], "source_file string"),
        "entities": spark.createDataFrame([(c, "N") for c, _ in chunks], "chunk_key long, name string"),
        "chunk_logs": spark.createDataFrame([(c,) for c, _ in chunks] + [(5,)], "chunk_key long"),
    }
    first = {}
    for k, s, u, _ in rows:
        if u is not None:
            first.setdefault((s, u), k)
    keep = {k for k, s, u, _ in rows if u is None or first[s, u] == k}
    edge = {}
    for e in edges:
        edge.setdefault(e[1:5], e)
    files = {f for k, _, _, f in rows if k in keep} | {e[5] for e in edge.values()}
    left = {c for c, k in chunks if k in keep}
    want = {"events": keep, "calls": keep & set(range(0, 300, 3)), "chunks": left, "edges": {e[0] for e in edge.values()}, "files": files, "entities": left, "chunk_logs": left}
    return tables, want


KEYS = {"events": "event_key", "calls": "event_key", "chunks": "chunk_key", "edges": "edge_key", "files": "source_file", "entities": "chunk_key", "chunk_logs": "chunk_key"}


def left(spark, root):
    return {t: {r[0] for r in migrations.present(spark, root, t).select(k).collect()} for t, k in KEYS.items()}


def test_pruned_once(spark, lake, tmp_path):
    tables, want = lake
    root = str(tmp_path / "lake")
    migrations.save(tables, root)
    counts = {r.table: (r.rows_before, r.rows_deleted) for r in migrations.drop_repeats(spark, root, list(tables)).collect()}
    assert left(spark, root) == want
    assert {t: counts[t] for t in KEYS} == {t: (tables[t].count(), tables[t].count() - len(want[t])) for t in KEYS}
    cube = migrations.present(spark, root, "cube").where("granularity = 'month'")
    assert cube.agg(F.sum("n_events")).first()[0] == len(want["events"])
    assert migrations.present(spark, root, "sessions").agg(F.sum("n_events")).first()[0] is not None
    # complete: later repeats are not touched
    assert migrations.drop_repeats(spark, root, list(tables)) is None


@pytest.mark.parametrize("broken", ["edges", "cube", "sentinel"])
def test_cut_off_and_done_again(spark, lake, tmp_path, monkeypatch, broken):
    tables, want = lake
    root = str(tmp_path / "lake")
    migrations.save(tables, root)
    plan = migrations.without_repeats

    def failing(old):
        made = plan(old)
        if broken in made:
            made[broken] = made[broken].withColumn("x", F.raise_error(F.lit("cut off")))
        return made

    if broken == "sentinel":
        (tmp_path / "lake" / "migrations").write_text("in the way")
        monkeypatch.setattr(migrations, "sentinels", lambda spark, root: spark.createDataFrame([], migrations._SENTINEL))
    with pytest.raises(Exception):  # noqa: B017
        migrations.migrate(spark, root, "without-repeats", list(tables), failing)
    monkeypatch.undo()
    if broken == "sentinel":
        (tmp_path / "lake" / "migrations").unlink()
    # readers still see the old tables
    assert migrations.present(spark, root, "events").count() == tables["events"].count()
    assert migrations.drop_repeats(spark, root, list(tables)) is not None
    assert left(spark, root) == want


def test_an_empty_lake(spark, lake, tmp_path):
    root = str(tmp_path / "lake")
    migrations.save({t: rows.limit(0) for t, rows in lake[0].items()}, root)
    assert {(r.rows_before, r.rows_deleted) for r in migrations.drop_repeats(spark, root, list(lake[0])).collect()} == {(0, 0)}


def test_names_of_the_layout_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        migrations.migrate(spark, str(tmp_path), "base", [], lambda t: t)
