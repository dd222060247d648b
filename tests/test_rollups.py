"""Kept cube and sessions against the whole computation, after growing, shrinking and vanishing events and cuts."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tracelake.operators import usage
from tracelake.sources import transcripts
from tracelake.streaming import ingest, rollups


def line(session, k, when, tokens=10):
    usage_ = {"input_tokens": tokens, "output_tokens": 5}
    return json.dumps({"type": "assistant", "uuid": f"{session}-{k}", "sessionId": session, "requestId": f"r{session}{k}", "timestamp": when, "message": {"role": "assistant", "model": "claude-sonnet-4-5", "content": "x", "usage": usage_}}) + "\n"


def plain(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def stamps(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_waves_refresh_what_they_touch(spark, tmp_path, monkeypatch):
    folder, lake = tmp_path / "logs" / "-home-a", tmp_path / "lake"
    folder.mkdir(parents=True)
    root, target = str(tmp_path / "logs"), str(lake)
    (folder / "a.jsonl").write_text(line("a", 1, "2025-09-29T10:00:00Z") + line("a", 2, "2025-10-01T10:00:00Z") + line("a", 3, None))
    (folder / "b.jsonl").write_text(line("b", 1, "2025-11-20T10:00:00Z") + line("a", 9, "2025-11-21T10:00:00Z"))
    (folder / "c.jsonl").write_text(line("c", 1, "2025-12-24T10:00:00Z"))

    def same():
        events = ingest.current_events(spark, target)
        assert plain(rollups.kept_cube(spark, target)) == plain(usage.cube(events))
        assert plain(rollups.kept_sessions(spark, target)) == plain(usage.sessions(events))

    assert rollups.drain(spark, root, target, wave=2) == [0, 1] and rollups.drain(spark, root, target) == []
    same()
    before = stamps(lake / "cube")
    with (folder / "c.jsonl").open("a") as f:  # one month grows
        f.write(line("c", 2, "2025-12-30T10:00:00Z"))
    assert rollups.drain(spark, root, target) == [2]
    same()
    kept = {p for p, t in stamps(lake / "cube").items() if before.get(p) == t}
    assert kept and all("m2025-12" not in p for p in kept) and any("m2025-11" in p for p in kept)
    # a cut after the wave is committed and its sessions are written, before its mark; a file loses a month and a session
    write = rollups._refresh_sessions

    def broken(*args):
        write(*args)
        raise RuntimeError("cut off")

    monkeypatch.setattr(rollups, "_refresh_sessions", broken)
    (folder / "b.jsonl").write_text(line("a", 9, "2025-11-21T10:00:00Z", tokens=99))
    with pytest.raises(RuntimeError):
        rollups.drain(spark, root, target)
    monkeypatch.setattr(rollups, "_refresh_sessions", write)
    assert rollups.rolled_waves(spark, target) == [0, 1, 2] and rollups.drain(spark, root, target) == [3]
    same()
    assert {r.session_id for r in rollups.kept_sessions(spark, target).collect()} == {"a", "c"}
    os.utime(folder / "c.jsonl", (1, 1))  # read again, nothing new
    assert rollups.drain(spark, root, target) == [4]
    same()


def test_a_refresh_reads_the_touched_months_only(spark, tmp_path):
    folder = tmp_path / "logs" / "-home-a"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text(line("a", 1, "2025-09-29T10:00:00Z") + line("a", 2, "2025-12-01T10:00:00Z"))
    ingest.drain(spark, str(tmp_path / "logs"), str(tmp_path / "lake"))
    some = ingest.current_events(spark, str(tmp_path / "lake"), F.col("month").isin("m2025-09"))
    assert [r.event_uuid for r in some.collect()] == ["a-1"]
    filters = [x.split("]", 1)[0] for x in some._jdf.queryExecution().toString().split("PartitionFilters: [")[1:]]
    assert any("month#" in x for x in filters)


def test_one_session_with_its_subagents(spark, tmp_path):
    folder = tmp_path / "-home-a b"
    (folder / "s1" / "subagents").mkdir(parents=True)
    usage_ = {"input_tokens": 3, "output_tokens": None, "cache_creation_input_tokens": 50, "cache_creation": {"ephemeral_5m_input_tokens": 7}}
    say = lambda uuid, when, **more: json.dumps({"type": "assistant", "uuid": uuid, "sessionId": "s1", "timestamp": when, "message": {"role": "assistant", "content": [{"type": "text", "text": "x"}], "usage": usage_}} | more) + "\n"
    snapshot = json.dumps({"type": "file-history-snapshot"}) + "\n"
    (folder / "s1.jsonl").write_text(say("m2", "2025-11-17T09:00:02Z", message={"role": "user", "content": "hello"}) + say("m0", None) + snapshot + "not json\n" + say("m1", "2025-11-17T09:00:01Z") + json.dumps({"uuid": "typeless"}) + "\n")
    (folder / "s1" / "subagents" / "agent-a-compact-53e7.jsonl").write_text(say("a1", "2025-11-17T09:00:02Z", isSidechain=True))
    (folder / "s2.jsonl").write_text(say("other", "2025-11-17T09:00:00Z"))
    (folder / "s1" / "deeper").mkdir()
    (folder / "s1" / "deeper" / "x.jsonl").write_text(say("deeper", "2025-11-17T09:00:00Z"))
    rows = transcripts.session_records(spark, str(tmp_path), "-home-a b", "s1").collect()
    assert [r.event_uuid for r in rows] == ["m1", "m2", "a1", "m0"]
    assert [(r.cache_creation_tokens, r.input_tokens, r.output_tokens) for r in rows] == [(7, 3, 0), (0, 0, 0), (7, 3, 0), (7, 3, 0)]
    assert [r.agent_slug for r in rows] == [None, None, "a-compact", None] and rows[1].message_content == "hello" and json.loads(rows[0].message_content)[0]["text"] == "x"
    assert [r.is_subagent_file for r in rows] == [False, False, True, False] and rows[2].is_sidechain
    for project, session in (("-home-a b", "s9"), ("nobody", "s1")):
        assert transcripts.session_records(spark, str(tmp_path), project, session).count() == 0
