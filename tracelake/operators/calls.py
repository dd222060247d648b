"""Calls made in events: tools, skills, subagents, programs, make targets, runner scripts and rule files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.filters import check_call_type, clamp_limit
from tracelake.functions.scalars import bucket
from tracelake.functions.shell import block_calls

#: The series of the calls timeline.
TIMELINE_TYPES = ("tool", "skill", "subagent", "cli", "rule")


def tool_calls(blocks: DataFrame) -> DataFrame:
    """Calls of tool-use blocks (event_key, ord, name, input JSON)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, at, name, given in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    arguments = json.loads(given) if given else None
                except ValueError:
                    arguments = None
                rows += [{"event_key": key, "ord": at, "call_type": t, "call_name": n} for t, n in block_calls(name, arguments)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("event_key", pa.int64()), ("ord", pa.int32()), ("call_type", pa.string()), ("call_name", pa.string())]))

    return blocks.select("event_key", "ord", "name", "input").mapInArrow(run, "event_key long, ord int, call_type string, call_name string")


def event_calls(events: DataFrame) -> DataFrame:
    """(event_key, ord, call_type, call_name, ts, project_id, session_id) of every call in the events' content blocks."""
    blocks = events.select("event_key", F.posexplode("blocks").alias("ord", "block"))
    kind = F.try_variant_get("block", "$.type", "string")
    tools = blocks.where(kind == "tool_use").select("event_key", "ord", F.try_variant_get("block", "$.name", "string").alias("name"), F.to_json(F.try_variant_get("block", "$.input", "variant")).alias("input"))
    reminders = F.regexp_extract_all(F.try_variant_get("block", "$.text", "string"), F.lit(r"(?s)<system-reminder>(.*?)</system-reminder>"), F.lit(1))
    paths = F.flatten(F.transform(reminders, lambda r: F.regexp_extract_all(r, F.lit(r"""Contents of\s+(/[^\s:'"]+)"""), F.lit(1))))
    rules = blocks.where(kind == "text").select("event_key", "ord", F.lit("rule").alias("call_type"), F.explode(paths).alias("call_name"))
    whole = tool_calls(tools).unionByName(rules)
    return whole.join(events.select("event_key", "ts", "project_id", "session_id"), "event_key")


def calls_timeline(calls: DataFrame, grain: str = "day") -> DataFrame:
    """Calls for each bucket and type; calls without a time left out."""
    return calls.where(F.col("ts").isNotNull()).groupBy(bucket(grain, F.col("ts")).alias("bucket"), "call_type").agg(F.count(F.lit(1)).alias("n_calls"))


def calls_pivot(calls: DataFrame, types: list[str], grain: str = "day") -> DataFrame:
    """One column of counts for each type, zero where there is none."""
    wide = calls.where(F.col("ts").isNotNull()).groupBy(bucket(grain, F.col("ts")).alias("bucket")).pivot("call_type", types).agg(F.count(F.lit(1)))
    return wide.fillna(0, types)


def top_calls(calls: DataFrame, call_type: str, *, limit: int = 20, exclude: list[str] | None = None, checked: bool = True) -> DataFrame:
    """The most frequent call names of a type with their calls and sessions; ties by name."""
    wanted = check_call_type(call_type) if checked else call_type
    rows = calls.where(F.col("call_type") == wanted)
    if exclude:
        rows = rows.where(~F.col("call_name").isin(exclude))
    counts = rows.groupBy("call_name").agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("session_id").alias("n_sessions"))
    return counts.orderBy(F.desc("n_calls"), "call_name").limit(clamp_limit(limit))
