from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracelake.functions import filters, pricing, scalars
from tracelake.functions.shell import block_calls, is_assignment, is_redirection, shell_calls


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("command", "heads"),
    [
        ("aws s3 ls | grep foo | wc -l", ["aws", "grep", "wc"]),
        ("FOO=bar sudo -E /usr/bin/gh pr list && echo ok", ["gh", "echo"]),
        ("for i in a b; do rm $i; done", ["rm"]),
        ("if test -f x; then cat x; fi", ["test", "cat"]),
        ("xargs -P 4 -n 1 curl", ["4"]),
        ('"" ; --', []),
        ("(cd /tmp; ls)", ["cd", "ls"]),
        ("env A=1 B=2 python x.py", ["python"]),
        ("", []),
    ],
)
def test_command_heads(command, heads):
    assert [n for t, n in shell_calls(command) if t == "cli"] == heads


@pytest.mark.parametrize(
    ("command", "kind", "names"),
    [
        ("make -C sub test format", "make_target", ["test", "format"]),
        ("make CI=true -j 4 ci 2>&1", "make_target", ["ci"]),
        ("make --directory=x build > log", "make_target", ["build", "log"]),
        ("uv run --directory sub tools/pytest tests/", "uv_script", ["pytest"]),
        ("uv sync", "uv_script", []),
        ("bun run --cwd=web dev", "bun_script", ["dev"]),
        ("bun run -c conf build", "bun_script", ["build"]),
    ],
)
def test_targets_and_scripts(command, kind, names):
    assert [n for t, n in shell_calls(command) if t == kind] == names


def test_words():
    assert is_assignment("FOO=bar") and is_assignment("_x=1") and not is_assignment("1FOO=bar") and not is_assignment("-foo=bar")
    assert all(map(is_redirection, ["&", ">log", "2>&1", "1>", "<"])) and not is_redirection("x>") and not is_redirection("22")


def test_blocks():
    assert list(block_calls("Skill", {"skill": " pdf "})) == [("skill", "pdf")]
    assert list(block_calls("Skill", {"skill": 3})) == [("tool", "Skill")]
    assert list(block_calls("Agent", {"subagent_type": "explore"})) == [("subagent", "explore")]
    assert list(block_calls("Bash", {"command": "ls | wc"})) == [("tool", "Bash"), ("cli", "ls"), ("cli", "wc")]
    assert list(block_calls("", {})) == [] and list(block_calls("Read", None)) == [("tool", "Read")]


def test_prices(spark):
    tokens = [F.lit(n) for n in (1000, 500, 200, 100)]
    assert one(spark, pricing.model_family(F.lit("claude-OPUS-4-5-2025"))) == "opus"
    assert one(spark, pricing.cost_usd(F.lit("claude-opus-4-5"), *tokens)) == pytest.approx((1000 + 2500 + 20 + 125) * 5 / 1e6)
    assert one(spark, pricing.cost_usd(F.lit("llama"), *tokens)) == 0
    assert one(spark, pricing.context_window(F.lit("x-sonnet-4-5-1"))) == 200_000
    assert one(spark, pricing.context_window(F.lit("llama"))) is None
    assert one(spark, pricing.context_ratio(F.lit(50), F.lit(0))) is None


@pytest.mark.parametrize(
    ("event", "meta", "first", "text", "sub", "kind"),
    [
        ("user", False, "string", "hi", False, "human"),
        ("user", False, "string", "  <task-notification> x", False, "task_notification"),
        ("user", True, "string", "hi", False, "meta"),
        ("user", False, "tool_result", "", False, "tool_result"),
        ("user", False, "text", "", True, "subagent-user_text"),
        ("assistant", False, "thinking", "", False, "thinking"),
        ("assistant", False, "tool_use", "", True, "subagent-tool_use"),
        ("assistant", False, None, "", False, "assistant_text"),
        ("system", False, None, "", False, "other"),
    ],
)
def test_kinds(spark, event, meta, first, text, sub, kind):
    assert one(spark, scalars.message_kind(F.lit(event), F.lit(meta), F.lit(first), F.lit(text), F.lit(sub))) == kind


def test_scopes(spark):
    path = scalars.scope_path(F.lit("/Users/someone/clients/acme/app/"))
    assert one(spark, path) == "clients/acme/app"
    assert one(spark, scalars.ancestors(path)) == ["", "clients", "clients/acme", "clients/acme/app"]
    assert one(spark, scalars.ancestors(F.lit(""))) == [""]
    assert one(spark, scalars.scope_depth(F.lit("a/b"))) == 2 and one(spark, scalars.scope_depth(F.lit(""))) == 0
    assert one(spark, scalars.parent_scope(F.lit("a/b"))) == "a" and one(spark, scalars.parent_scope(F.lit("a"))) == "" and one(spark, scalars.parent_scope(F.lit(""))) is None
    assert one(spark, scalars.in_subtree(F.lit("a/bc"), "a/b")) is False and one(spark, scalars.in_subtree(F.lit("a/b/c"), "a/b")) is True


def test_times(spark):
    ts = F.lit(datetime(2024, 1, 3, 7, 8, 9)).cast("timestamp")
    assert [one(spark, scalars.bucket(g, ts)) for g in ("hour", "day", "week", "month")] == ["2024-01-03T07", "2024-01-03", "2024-01-01", "2024-01"]
    with pytest.raises(ValueError):
        scalars.bucket("year", ts)
    assert one(spark, scalars.delta_ms(ts, ts + F.expr("INTERVAL 2 SECONDS"))) == 2000
    assert one(spark, scalars.delta_ms(ts + F.expr("INTERVAL 2 SECONDS"), ts)) is None
    assert one(spark, scalars.tokens_per_second(F.lit(200), F.lit(2000))) == 100 and one(spark, scalars.tokens_per_second(F.lit(200), F.lit(0))) is None


@pytest.mark.parametrize(
    ("reason", "raw", "category"),
    [
        ("prompt decode failed (rc=-3)", "", "context_overflow"),
        ("x must be a JSON array", "{}", "non_array_lens"),
        ("missing lens keys: a", "{}", "missing_lens_key"),
        ("No balanced JSON object found", '{"a": [', "truncated_json"),
        ("No balanced JSON object found", "sorry", "empty_or_refusal"),
        ("Unterminated string at 5", "{", "truncated_json"),
        ("Expecting value", "{", "malformed_json"),
        ("odd", " ", "empty_or_refusal"),
        ("odd", "x", "other"),
    ],
)
def test_failures(spark, reason, raw, category):
    assert one(spark, scalars.failure_category(F.lit(reason), F.lit(raw))) == category


def test_filters(spark):
    now = datetime(2024, 1, 10)
    rows = spark.createDataFrame([(datetime(2024, 1, d), p) for d, p in ((1, "-Users-me-work-x"), (5, "-Users-me-play-y"), (9, "it's"))], "ts timestamp, project_id string")
    count = lambda **k: filters.filtered(rows, now=now, **k).count()
    assert [count(days=n) for n in (None, 0, -5, 7)] == [3, 3, 3, 2]
    assert count(project="it's") == 1 and count(blocked=["work"]) == 2
    with pytest.raises(LookupError):
        filters.require_allowed("-Users-me-work-x", ["work"])
    with pytest.raises(ValueError):
        filters.check_call_type("nope")
    assert [filters.clamp_limit(n) for n in (-1, 20, 9999)] == [1, 20, 500]
    assert rows.where(filters.of_kind("nope", F.col("project_id"))).count() == 3
