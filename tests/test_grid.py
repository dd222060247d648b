"""The evaluation grid: records against plain Python, failures as data, resume, ranking."""

from __future__ import annotations

import datetime

import pytest

from tracelake.operators import grid, text_metrics

SAID = [
    ("p1", "s1", 1, "fix the parser of dates. it loses the zone"),
    ("p1", "s1", 2, "now add a test for zones"),
    ("p1", "s2", 9, "explain the retry loop. it never ends"),
    ("p2", "s3", 1, "broken input"),
    ("p3", "s4", 2, "no scope for this project"),
    ("p1", "s5", 3, "  "),
]
SCOPES = [("p1", "a/p1"), ("p2", "b/p2"), ("p3", None)]


def first_words(text):
    if "broken" in text:
        raise ValueError("no reply")
    return " ".join(text.split()[:5])


def all_words(text):
    return " ".join(w for w in text.split() if w not in ("Child", "1:", "2:"))


@pytest.fixture(scope="module")
def tables(spark):
    start = datetime.datetime(2025, 3, 3)
    rows = [(p, s, k, "human", t, start + datetime.timedelta(days=day)) for k, (p, s, day, t) in enumerate(SAID)]
    events = spark.createDataFrame(rows, "project_id string, session_id string, event_key int, msg_kind string, message_content string, ts timestamp")
    return events, spark.createDataFrame(SCOPES, "project_id string, scope string")


def mean(rows, metric):
    return sum(r[metric] for r in rows) / len(rows)


def test_grid(spark, tables, tmp_path):
    target = str(tmp_path / "grid")
    models = {"large": grid.Model(7, all_words), "small": grid.Model(1, first_words), "absent": grid.Model(0.5, None)}
    plan = [(r.model, r.available, r.done) for r in grid.cells(spark, target, models, ["flat"], ["month"]).collect()]
    assert plan == [("absent", False, False), ("small", True, False), ("large", True, False)]
    # a first run of one model and grain, then the rest
    assert grid.run_grid(*tables, target, {"small": models["small"]}, strategies=["flat"], grains=("month",)) == 1
    first = {r.permutation_id: r.asDict() for r in grid.ranked(spark, target).collect()}

    def never(text):
        raise RuntimeError("the cell is done")

    assert grid.run_grid(*tables, target, {"small": grid.Model(1, never)}, strategies=["flat"], grains=("month",)) == 0
    assert grid.run_grid(*tables, target, models, strategies=["flat", "strict"], grains=("day", "month")) == 7
    rows = grid.ranked(spark, target).collect()
    assert [r.permutation_id for r in rows] == [r.permutation_id for r in sorted(rows, key=lambda r: (-r.combined, r.permutation_id))]
    got = {r.permutation_id: r.asDict() for r in rows}
    assert len(got) == 8 and got["small__flat__month"] == first["small__flat__month"]
    sources = {"s1": "fix the parser of dates. it loses the zone\nnow add a test for zones", "s2": "explain the retry loop. it never ends", "s3": "broken input"}
    own = [text_metrics.score(first_words(sources[s]), sources[s]) for s in ("s1", "s2")]
    cell = got["small__flat__month"]
    assert cell["status"] == "error" and cell["n_failed"] == 1 and cell["n_sessions_scored"] == 2
    assert (cell["source_sessions"], cell["source_texts"], cell["source_tokens"]) == (3, 4, 24)
    for m in text_metrics.SCORES:
        assert cell[f"session_{m}"] == pytest.approx(mean(own, m))
    # flat by months: the root, a and a/p1 all have the summaries of both sessions; the root's source has the broken one too
    rollup = first_words("\n\n".join(f"Child {n}: {first_words(sources[s])}" for n, s in enumerate(("s1", "s2"), 1)))
    below = "\n".join([sources["s1"], sources["s2"]])
    want = [text_metrics.score(rollup, r) for r in (below + "\n" + sources["s3"], below, below)]
    assert cell["rollup_rows"] == cell["n_rollups_scored"] == 3
    for m in text_metrics.SCORES:
        assert cell[f"rollup_{m}"] == pytest.approx(mean(want, m))
    assert cell["combined"] == pytest.approx(sum(mean(want, m) for m in grid.RANKED_BY) / 3)
    # by day a, a/p1 and the root have two roll-ups each, as s1 and s3 begin on one day, b and b/p2 one
    whole = got["large__strict__day"]
    assert whole["status"] == "ok" and whole["rollup_rows"] == 3 * 2 + 2 and whole["n_rollups_scored"] == 5
    assert whole["session_embed_cosine"] == pytest.approx(1.0, abs=1e-6)


def test_grid_without_sessions(spark, tables, tmp_path):
    target = str(tmp_path / "grid")
    assert grid.run_grid(tables[0].limit(0), tables[1], target, {"m": grid.Model(1, first_words)}, strategies=["strict", "reground"], grains=("day",)) == 2
    for r in grid.ranked(spark, target).collect():
        assert (r.status, r.n_sessions_scored, r.n_rollups_scored, r.combined, r.session_f1) == ("ok", 0, 0, 0.0, None)


def test_unknown_strategies_are_refused(spark, tables, tmp_path):
    with pytest.raises(KeyError):
        grid.run_grid(*tables, str(tmp_path), {"m": grid.Model(1, first_words)}, strategies=["best"])
