from __future__ import annotations

import json

import pytest

from tracelake.operators import calls, claims, schema_timeline, search, timing, usage
from tracelake.sources import transcripts
from tracelake.streaming.ingest import changed_events, current_events, drain, ingest


def record(kind, at, content, **more):
    usage = {"input_tokens": 640, "output_tokens": 830, "cache_read_input_tokens": 3000, "cache_creation_input_tokens": 40}
    message = {"role": kind, "content": content}
    if kind == "assistant":
        message |= {"model": "claude-opus-4-5-x", "usage": usage, "stop_reason": more.pop("stop", None)}
    return json.dumps({"type": kind, "timestamp": f"2025-11-17T{at}Z", "sessionId": "s1", "message": message} | more)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    project = root / "-Users-me-play-app"
    (project / "s1" / "subagents").mkdir(parents=True)
    lines = [
        record("user", "14:20:31", "which tests are slow?", uuid="u1"),
        record("assistant", "14:20:44", [{"type": "thinking", "thinking": "hm", "signature": "zzz"}], uuid="u2", parentUuid="u1", requestId="r1"),
        record("assistant", "14:20:50", [{"type": "tool_use", "name": "Bash", "input": {"command": "make test | wc"}}, {"type": "text", "text": "done"}], uuid="u3", parentUuid="u2", requestId="r1", stop="end_turn"),
        "",
        "not json",
        json.dumps({"type": "file-history-snapshot"}),
        record("user", "14:22:05", [{"type": "text", "text": "<system-reminder>Contents of /a/rules.md: x</system-reminder>"}], uuid="u4", parentUuid="u3"),
    ]
    (project / "s1.jsonl").write_text("\n".join(lines) + "\n")
    (project / "s1" / "subagents" / "agent-x.jsonl").write_text(record("user", "14:20:47", "sub", uuid="u5", isSidechain=True) + "\n" + record("user", "14:20:31", "which tests are slow?", uuid="u1") + "\n")
    (project / "agent-slug-abc123.jsonl").write_text(record("user", "14:20:49", "root agent", uuid="u6") + "\n")
    (project / "sessions-index.json").write_text(json.dumps({"version": 1, "entries": [{"projectPath": "/Users/me/play/app"}]}))
    return root


def test_events(spark, tree):
    rows = {r.event_uuid: r for r in transcripts.read_events(spark, str(tree)).collect()}
    assert sorted(rows) == ["u1", "u2", "u3", "u4", "u5", "u6"]
    assert {r.project_id for r in rows.values()} == {"-Users-me-play-app"} and {r.session_id for r in rows.values()} == {"s1"}
    assert [rows[u].msg_kind for u in sorted(rows)] == ["human", "thinking", "tool_use", "user_text", "subagent-human", "subagent-human"]
    assert [rows[u].is_head for u in ("u1", "u2", "u3")] == [True, False, True]
    assert (rows["u2"].output_tokens, rows["u3"].output_tokens) == (0, 830)
    assert rows["u3"].duration_ms == 19000 and rows["u3"].line_number == 3
    assert rows["u3"].cost_usd == pytest.approx((640 + 5 * 830 + 0.1 * 3000 + 1.25 * 40) * 5 / 1e6)
    assert rows["u3"].context_ratio == pytest.approx(3680 / 200_000)
    assert rows["u3"].message_content == "[tool: Bash]\ndone" and rows["u2"].message_content == "hm"


def test_turns_and_calls(spark, tree):
    events = transcripts.read_events(spark, str(tree))
    turn = timing.turns(events).collect()
    assert [(t.active_ms, t.idle_ms, t.too_fast) for t in turn] == [(19000, 75000, True)]
    found = sorted((r.call_type, r.call_name, r.ord) for r in calls.event_calls(events).collect())
    assert found == [("cli", "make", 0), ("cli", "wc", 0), ("make_target", "test", 0), ("rule", "/a/rules.md", 0), ("tool", "Bash", 0)]
    assert {(r.event_uuid, r.parent_uuid) for r in transcripts.edges(events).collect()} == {("u2", "u1"), ("u3", "u2"), ("u4", "u3")}


def test_files_and_lines(spark, tree):
    found = transcripts.discover(spark, str(tree))
    assert sorted((r.file_type, r.session_stem) for r in found.collect()) == [("agent_root", "agent-slug-abc123"), ("main_session", "s1"), ("subagent", "s1")]
    assert transcripts.changed_files(found, found).count() == 0
    assert transcripts.changed_files(found, found.where("file_type <> 'subagent'")).count() == 1
    lines = transcripts.raw_lines(spark, str(tree))
    path = next(r.file_path for r in lines.where("file_type = 'main_session'").collect())
    assert "which tests are slow?" in transcripts.read_line(lines, path, 1).first().line
    assert transcripts.project_paths(spark, str(tree)).first().project_path == "/Users/me/play/app"


def test_schema_timeline(spark, tree):
    lines = transcripts.raw_lines(spark, str(tree)).selectExpr("'2025-11-17' AS date", "raw")
    rows = {(r.json_path, r.event_date): r for r in schema_timeline.schema_timeline(schema_timeline.key_paths(lines)).collect()}
    assert rows[("$.message.content[].input.command", "2025-11-17")].n_events == 1
    assert all(r.n_events > 0 and r.first_seen == "2025-11-17" for r in rows.values())


def test_summaries_skip_what_is_done(spark, tree):
    texts = claims.session_texts(transcripts.read_events(spark, str(tree)))
    made = claims.summarise(texts, claims.lead_engine, "lead")
    assert made.first().summary.startswith("which tests are slow?")
    assert claims.pending(texts, made, "lead").count() == 0 and claims.pending(texts, made, "other").count() == 1


def test_stream_of_waves(spark, tree, tmp_path):
    query = ingest(spark, str(tree), str(tmp_path / "events"), str(tmp_path / "state"), wave=1)
    query.awaitTermination(180)
    rows = [r.event_uuid for r in spark.read.parquet(str(tmp_path / "events")).collect()]
    assert sorted(rows) == ["u1", "u2", "u3", "u4", "u5", "u6"]
    assert len(list((tmp_path / "events").glob("wave=*"))) == 3


def test_drain_reads_changed_files_again(spark, tmp_path):
    logs, target = tmp_path / "logs", str(tmp_path / "lake")
    folder = logs / "-home-a b"
    folder.mkdir(parents=True)
    line = lambda k, text: record("user", f"09:{k // 60:02d}:{k % 60:02d}", text, uuid=f"v{k}")
    (folder / "one.jsonl").write_text("".join(line(k, f"text {k}") + "\n" for k in range(3)))
    (folder / "two.jsonl").write_text("".join(line(k, f"text {k}") + "\n" for k in range(10, 14)))
    (folder / "three.jsonl").write_text(line(20, "text 20") + "\n" + line(1, "seen before") + "\n")
    texts = lambda: sorted((r.event_uuid, r.message_content) for r in current_events(spark, target).collect())
    assert drain(spark, str(logs), target, wave=2) == [0, 1] and drain(spark, str(logs), target, wave=2) == []
    assert [u for u, _ in texts()] == ["v0", "v1", "v10", "v11", "v12", "v13", "v2", "v20"]
    cube = usage.cube(current_events(spark, target)).collect()
    with (folder / "one.jsonl").open("a") as f:  # appended
        f.write(line(70, "more") + "\n")
    (folder / "two.jsonl").write_text(line(10, "text 10") + "\n")  # shrunk
    (folder / "three.jsonl").write_text(line(30, "other") + "\n")  # replaced
    waves = drain(spark, str(logs), target, wave=5)
    assert waves == [2]
    now = [("v0", "text 0"), ("v1", "text 1"), ("v10", "text 10"), ("v2", "text 2"), ("v30", "other"), ("v70", "more")]
    assert texts() == now
    old = spark.createDataFrame(cube, usage.cube(current_events(spark, target)).schema)
    plain = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)
    events = current_events(spark, target)
    assert plain(usage.refreshed_cube(old, events, changed_events(spark, target, waves))) == plain(usage.cube(events))


def test_raw_event_and_search(spark, tree):
    events, lines = transcripts.read_events(spark, str(tree)), transcripts.raw_lines(spark, str(tree))
    assert json.loads(transcripts.raw_event(lines, events, "-Users-me-play-app", "s1", "u4").first().line)["parentUuid"] == "u3"
    assert transcripts.raw_event(lines, events, "-Users-me-play-app", "s1", "nope").count() == 0
    from pyspark.sql import functions as F

    hit = search.search_events(events, "slow tests", "event_uuid", "message_content", where=F.col("msg_kind") == "human").collect()
    assert [(r.event_uuid, r.snippet) for r in hit] == [("u1", "which <mark>tests</mark> are <mark>slow</mark>")]
    assert search.search_events(events, "slow tests", "event_uuid", "message_content", where=F.col("msg_kind") == "tool_use").count() == 0
    near = search.search_events(events, "which tests are slow?", "event_uuid", "message_content", mode="semantic", limit=2).collect()
    assert (near[0].event_uuid, near[0].distance) == ("u1", 0.0)
    metrics = timing.session_metrics(events).first()
    assert metrics.avg_tps == round(830 * 1000 / 19000, 4) and metrics.peak_context_ratio == pytest.approx(3680 / 200_000)


def test_more_scalars(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from tracelake.functions import scalars

    block = json.dumps({"message": {"content": [{"type": "thinking", "thinking": "a", "signature": 'x"y'}, {"signature": "s", "type": "thinking", "thinking": ""}]}})
    row = spark.createDataFrame([(block, datetime(2025, 7, 1, 22, 30), ["b", "a"], ["c", "a"], [[3.0, 0.0], [0.0, 4.0]])], "line string, ts timestamp, p array<string>, q array<string>, v array<array<double>>")
    got = row.select(scalars.without_signatures(F.col("line")).alias("line"), scalars.local_iso(F.col("ts"), "Europe/Berlin").alias("local"), scalars.ordered_union(F.col("p"), F.col("q")).alias("u"), search.mean_pooled(F.col("v")).alias("m")).first()
    assert json.loads(got.line) == {"message": {"content": [{"type": "thinking", "thinking": "a"}, {"type": "thinking", "thinking": ""}]}}
    assert got.local == "2025-07-02T00:30:00.000" and got.u == ["b", "a", "c"] and got.m == pytest.approx([0.6, 0.8])
    ids = spark.createDataFrame([("-home-ann-my-app",), ("-home-ann-my-app-sub",), ("-srv-x",)], "project_id string")
    folders = spark.createDataFrame([("/home",), ("/home/ann",), ("/home/ann/my-app",), ("/home/ann/my.app",)], "path string")
    found = {r.project_id: r.path for r in transcripts.decoded_projects(ids, folders).collect()}
    assert found == {"-home-ann-my-app": "/home/ann/my-app", "-home-ann-my-app-sub": "/home/ann/my-app/sub", "-srv-x": "/srv/x"}
