"""The driver's Parquet tables and their reading as session events, calls and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.pricing import cost_usd

#: Event types of the table as models, message kinds and call types.
MODELS = {"click": "claude-opus-4-5", "view": "claude-sonnet-4-5", "purchase": "claude-haiku-4-5", "signup": "local-model", "error": "claude-sonnet-4-6"}
KINDS = {"click": "assistant_text", "view": "human", "purchase": "assistant_text", "signup": "tool_use", "error": "tool_result"}
CALLS = {"click": "tool", "view": "skill", "purchase": "cli", "signup": "subagent", "error": "rule"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(values: dict[str, str]):
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("event_type"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as session events: ten projects, a session for each user and day."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = _mapped(KINDS)
    rows = e.select(
        F.col("event_id").alias("event_key"),
        "user_id",
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        "ts",
        _mapped(MODELS).alias("model_id"),
        kind.alias("msg_kind"),
        F.when(kind == "assistant_text", "assistant").otherwise("user").alias("event_type"),
        k.alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
        (k * 10).alias("cache_read_tokens"),
        (k * 2).alias("cache_creation_tokens"),
        (F.col("user_id") % 7 == 0).alias("is_sidechain"),
        F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string"))).alias("agent_id"),
        F.lit(True).alias("is_head"),
        F.when(F.col("event_id") % 2 == 0, "end_turn").alias("stop_reason"),
        (F.col("event_id") % 5 * 500).alias("duration_ms"),
        (k / 99.0).alias("context_ratio"),
    )
    tokens = [F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]
    return rows.withColumn("cost_usd", cost_usd(F.col("model_id"), *tokens))


def session_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as calls: the type from the event type, the name from the value of k."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("n"), (F.get_json_object("props", "$.k").cast("long") % 20).cast("string"))
    return e.select(F.col("event_id").alias("event_key"), "ts", F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project_id"), F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), _mapped(CALLS).alias("call_type"), name.alias("call_name"))


def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent links between events: heaps of sixteen consecutive ids."""
    at = F.col("event_id") % 16
    return table(spark, sf_dir, "events").where(at > 0).select((F.col("event_id") - at + F.floor((at - 1) / 2)).alias("parent"), F.col("event_id").alias("child"))


def project_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, scope): the projects of the events in a small hierarchy."""
    ids = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("id")).where("id IS NOT NULL").distinct()
    group = F.when(F.col("id") % 2 == 0, "clients").otherwise("play")
    return ids.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("project_id"), F.concat_ws("/", group, F.concat(F.lit("g"), (F.col("id") % 3).cast("string")), F.concat(F.lit("p"), F.col("id").cast("string"))).alias("scope"))


def session_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as claims of its sessions, one for each call."""
    return session_calls(spark, sf_dir).select("project_id", "session_id", F.col("call_type").alias("lens"), F.concat(F.lit(" Uses  "), F.upper("call_name")).alias("claim"))


def claim_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error events as failed extractions."""
    k = F.get_json_object("props", "$.k").cast("long")
    reason = F.when(k % 7 == 0, "prompt decode failed (rc=-3)").when(k % 7 == 1, "lens x must be a JSON array").when(k % 7 == 2, "missing lens keys: y").when(k % 7 == 3, "no balanced JSON object found").when(k % 7 == 4, "Unterminated string").when(k % 7 == 5, "Expecting value").otherwise("strange")
    raw = F.when(k % 2 == 0, '{"a": [').otherwise("")
    base = session_calls(spark, sf_dir).select("event_key", "project_id", "session_id")
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "error").select(F.col("event_id").alias("event_key"), reason.alias("reason"), raw.alias("raw_excerpt"))
    return e.join(base, "event_key")
