from __future__ import annotations

import json

import pytest

from tracelake.functions import model_output
from tracelake.operators import kg_payload, summaries
from tracelake.sources import sinks


def test_first_object():
    assert model_output.first_object('<think>{x}</think> say {"a": "}{", "b": [1]} end') == {"a": "}{", "b": [1]}
    with pytest.raises(ValueError, match="no balanced JSON"):
        model_output.first_object('{"a": [')
    with pytest.raises(KeyError):
        model_output.lenses('{"task_summary": 1}')
    with pytest.raises(ValueError, match="must be a JSON array"):
        model_output.claim_lists(json.dumps(dict.fromkeys(model_output.CLAIM_LENSES, "x")))
    assert model_output.cluster_name('{"name": " tests "}') == "tests"


SESSIONS = [("s1", "h1", "a/b", "w1", "one"), ("s2", "h2", "a/b", "w1", "two"), ("s3", "h3", "a/c", "w1", "three"), ("s4", "h4", "a", "w2", "four")]


@pytest.mark.parametrize(("strategy", "root"), [("strict", 1), ("flat", 3), ("reground", 1)])
def test_roll_up(spark, strategy, root):
    rows = spark.createDataFrame(SESSIONS, "session_id string, content_hash string, scope string, bucket string, summary string")
    excerpts = spark.createDataFrame([("", "w1", "raw words")], "scope string, bucket string, text string")
    made = {(r.scope, r.bucket): r for r in summaries.roll_up(rows, strategy, lambda p: p, excerpts=excerpts).collect()}
    assert set(made) == {("a/b", "w1"), ("a/c", "w1"), ("a", "w1"), ("a", "w2"), ("", "w1"), ("", "w2")}
    assert made[("", "w1")].child_count == root and made[("a/b", "w1")].child_count == 2
    assert ("raw words" in made[("", "w1")].summary) == (strategy == "reground")
    assert "three" in made[("", "w1")].summary


def test_roll_up_takes_over_what_is_known(spark):
    rows = spark.createDataFrame(SESSIONS, "session_id string, content_hash string, scope string, bucket string, summary string")
    first = summaries.roll_up(rows, "flat", lambda p: p)
    again = summaries.roll_up(rows, "flat", lambda p: "new", known=first)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    with pytest.raises(KeyError):
        summaries.merger("odd")


def test_claims_split_and_fail(spark):
    texts = spark.createDataFrame([("s1", ["aa" * 10, "bb" * 10]), ("s2", ["bad"])], "session_id string, texts array<string>")

    def engine(prompt):
        return "sorry" if prompt == "bad" else json.dumps({k: [prompt[:2]] for k in model_output.CLAIM_LENSES})

    rows = summaries.extract_claims(texts, engine, most_chars=30).collect()
    assert [(r.claim_index, r.claim) for r in rows if r.lens == "tasks"] == [(0, "aa"), (1, "bb")]
    assert [r.session_id for r in rows if r.reason] == ["s2"]


def test_payload(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "e", 1.0)], "src string, dst string, weight double")
    nodes = kg_payload.selection(edges, top=1, metric="degree", max_depth=1)
    assert sorted(r.node for r in nodes.collect()) == ["a", "b", "c"]
    assert kg_payload.selected_edges(edges, nodes).count() == 2
    assert sorted(r.node for r in kg_payload.selection(edges, top=1, max_depth=0, min_degree=2).collect()) == ["b", "c", "d"]
    mentions = spark.createDataFrame([("c", 5), ("a", 1)], "name string, mentions long")
    groups = spark.createDataFrame([(n, "g") for n in "abc"], "node string, community string")
    assert kg_payload.community_lists(nodes, groups, mentions).first().label == "c, a, b"
    assert kg_payload.community_lists(nodes, groups, mentions, lambda m: m[0].upper()).first().label == "C"
    with pytest.raises(ValueError):
        kg_payload.selection(edges, metric="odd")


def test_offline_extraction(spark):
    chunks = spark.createDataFrame([(1, "see src/main.py and MAX_SIZE in DataFrame, toString"), (2, "MAX_SIZE of src/main.py")], "chunk_id long, chunk string")
    mentions = kg_payload.entities(chunks)
    assert {(r.name, r.type, r.mentions) for r in kg_payload.dominant_types(mentions).collect()} == {("src/main.py", "file", 2), ("MAX_SIZE", "constant", 2), ("DataFrame", "name", 1)}
    assert {(r.src, r.dst): r.weight for r in kg_payload.relations(mentions).collect()}[("MAX_SIZE", "src/main.py")] == 2


def test_records(spark, tmp_path):
    sinks.write_records(spark.createDataFrame([("p1", 1, 0.3, 0.3, 0.3), ("p2", 0, 0.9, 0.9, 0.9), ("p0", 2, 0.3, 0.3, 0.3)], sinks.RECORD), str(tmp_path / "r"))
    assert [r.permutation_id for r in sinks.ranked_records(spark, str(tmp_path / "r")).collect()] == ["p0", "p1", "p2"]
    sizes = spark.createDataFrame([("m", n) for n in range(1, 101)], "model string, tokens long")
    assert sinks.fitting_share(sizes, "model", "tokens", [50]).first().fits_50 == 50.0


def test_claims_of_one_long_text_and_of_unreadable_replies(spark):
    import json

    def engine(prompt):
        if len(prompt) > 3000:
            return '{"tasks": ["cut off'
        return json.dumps({"tasks": sorted(set(prompt.split())), "patterns": [], "decisions_values": [], "learnings": []})

    words = [f"w{n:05d}" for n in range(2000)]
    texts = spark.createDataFrame([("lines", ["\n".join(words)]), ("spaces", [" ".join(words)]), ("several", [" ".join(words[:600]), " ".join(words[600:])])], "session_id string, texts array<string>")
    for room in (24_000, 5_000):
        rows = summaries.extract_claims(texts, engine, most_chars=room).collect()
        assert not [r for r in rows if r.reason]
        for session in ("lines", "spaces", "several"):
            found = sorted((r.claim_index, r.claim) for r in rows if r.session_id == session)
            assert [c for _, c in found] == words
    assert summaries.split_texts(["short"]) == summaries.split_texts([]) == []
    left, right = summaries.split_texts(["x" * 5000])
    assert left[0] + right[0] == "x" * 5000
