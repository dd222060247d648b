"""Time buckets, kinds, paths and text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_FORMATS = {"hour": "yyyy-MM-dd'T'HH", "day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM"}
BASE_KINDS = ("human", "meta", "task_notification", "tool_result", "user_text", "thinking", "tool_use", "assistant_text", "other")
ALL_KINDS = (*BASE_KINDS, *(f"subagent-{k}" for k in BASE_KINDS))


def bucket(grain: str, ts: Column) -> Column:
    """The hour, day, Monday week or month of a timestamp as a string that sorts in time order."""
    if grain not in BUCKET_FORMATS:
        raise ValueError(f"unknown grain {grain!r}")
    return F.date_format(F.date_trunc(grain, ts), BUCKET_FORMATS[grain])


def delta_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end; null if either is missing or the difference is negative."""
    ms = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    return F.when(ms >= 0, ms)


def tokens_per_second(tokens: Column, ms: Column) -> Column:
    return F.when(ms > 0, F.round(tokens * 1000.0 / ms, 2))


def message_kind(event_type: Column, is_meta: Column, first_block: Column, text: Column, is_subagent: Column) -> Column:
    """The message kind of an event from its type, flags and the type of its first content block (``string`` for plain text)."""
    notice = F.startswith(F.ltrim(text), F.lit("<task-notification>"))
    user = F.when(is_meta, "meta").when((first_block == "string") & notice, "task_notification").when(first_block == "string", "human").when(first_block == "tool_result", "tool_result").otherwise("user_text")
    assistant = F.when(first_block == "thinking", "thinking").when(first_block == "tool_use", "tool_use").otherwise("assistant_text")
    base = F.when(event_type == "user", user).when(event_type == "assistant", assistant).otherwise("other")
    return F.when(is_subagent, F.concat(F.lit("subagent-"), base)).otherwise(base)


def scope_path(path: Column) -> Column:
    """A project path without its home directory and outer slashes."""
    return F.regexp_replace(F.regexp_replace(path, "^/(Users|home)/[^/]+", ""), "^/+|/+$", "")


def ancestors(scope: Column) -> Column:
    """All prefixes of a scope path, the root ``''`` first, the path itself last."""
    parts = F.filter(F.split(scope, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scope_depth(scope: Column) -> Column:
    return F.when(scope == "", 0).otherwise(F.size(F.split(scope, "/")))


def parent_scope(scope: Column) -> Column:
    """The scope above; null above the root."""
    up = F.regexp_replace(scope, "/?[^/]*$", "")
    return F.when(scope != "", up)


def in_subtree(scope: Column, top: str) -> Column:
    return F.lit(True) if top == "" else (scope == top) | F.startswith(scope, F.lit(f"{top}/"))


def encode_project(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("-"))


def project_name(project_id: Column) -> Column:
    """The last part of an encoded project id."""
    return F.element_at(F.split(F.rtrim(project_id, F.lit("-")), "-"), -1)


def domain_of(project_id: Column) -> Column:
    """The first part after the home directory of an encoded project id."""
    return F.nullif(F.regexp_extract(project_id, "^-(?:Users|home)-[^-]+-([^-]+)", 1), F.lit(""))


def agent_slug(file_name: Column) -> Column:
    return F.nullif(F.regexp_extract(file_name, r"agent-(.+?)(?:-[0-9a-f]+)?\.jsonl$", 1), F.lit(""))


def normal_claim(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def content_hash(texts: Column) -> Column:
    """SHA-256 of an ordered array of texts, a NUL after each."""
    return F.sha2(F.array_join(F.transform(texts, lambda t: F.concat(t, F.lit("\0"))), ""), 256)


def failure_category(reason: Column, excerpt: Column) -> Column:
    """One of seven classes of a failed claim extraction, by ordered rules on its message and raw output."""
    r, raw = F.lower(reason), F.trim(excerpt)
    has = lambda s: F.contains(r, F.lit(s))
    began = F.contains(raw, F.lit("{")) & (F.contains(raw, F.lit('"')) | F.contains(raw, F.lit("[")))
    syntax = has("expecting") | has("unterminated") | has("delimiter") | has("invalid control") | has("extra data")
    return (
        F.when(has("decode failed") | has("muninn_chat"), "context_overflow")
        .when(has("must be a json array"), "non_array_lens")
        .when(has("missing lens keys"), "missing_lens_key")
        .when(has("no balanced json object found"), F.when(began, "truncated_json").otherwise("empty_or_refusal"))
        .when(syntax, F.when(has("unterminated"), "truncated_json").otherwise("malformed_json"))
        .when(raw == "", "empty_or_refusal")
        .otherwise("other")
    )


def endpoint_template(url: Column) -> Column:
    """A URL with its identifiers and query values replaced by placeholders."""
    path = F.regexp_replace(url, r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f-]+", "{id}")
    return F.regexp_replace(F.regexp_replace(path, r"/\d+(?=/|$|\?|#)", "/{n}"), r"=[^&#]*", "={v}")


def human_number(n: Column) -> Column:
    """1.2M, 592k or the plain number."""
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 1), F.lit("M"))).when(n >= 1000, F.concat(F.format_number(n / 1000, 0), F.lit("k"))).otherwise(n.cast("string"))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at place floor(n p), capped, of a sorted array."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), F.least(n, F.floor(n * p).cast("int") + 1))


def local_iso(ts: Column, zone: str) -> Column:
    """A UTC time as ISO text in a named zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def without_signatures(line: Column) -> Column:
    """A JSON line whose thinking blocks have lost their signatures; other lines stay as they are."""
    member = r'"signature"\s*:\s*"(?:[^"\\]|\\.)*+"'
    bare = F.regexp_replace(F.regexp_replace(line, rf",\s*{member}", ""), rf"{member}\s*,?\s*", "")
    return F.when(F.rlike(line, F.lit(r'"type"\s*:\s*"thinking"')), bare).otherwise(line)


def ordered_union(*arrays: Column) -> Column:
    """The values of arrays in order, each where it comes first."""
    return F.array_distinct(F.concat(*arrays))


def encoded_path(path: Column) -> Column:
    """A folder path as project ids spell it: every character but ASCII letters and digits a dash."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")
