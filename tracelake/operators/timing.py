"""Turns: idle and active time, throughput, context use, and the event timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import delta_ms, tokens_per_second
from tracelake.operators.usage import money
from tracelake.sources.scratch import settled

#: A reply sooner than its tokens can be read at this rate is too fast, if it has this many.
READ_TOKENS_PER_SECOND = 8
LEAST_TOKENS = 200


def turns(events: DataFrame) -> DataFrame:
    """One row for each turn end on the main thread: active time since the last human prompt at or before it, idle time until the next event."""
    order = W.partitionBy("project_id", "session_id").orderBy(F.col("ts").asc_nulls_last(), "event_key")
    asked = F.last(F.when(F.col("msg_kind") == "human", F.col("ts")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    seen = events.where(~F.col("is_sidechain")).withColumn("asked", asked).withColumn("next_ts", F.lead("ts").over(order))
    ends = seen.where((F.col("event_type") == "assistant") & F.col("is_head") & (F.col("stop_reason") == "end_turn"))
    idle = delta_ms(F.col("ts"), F.col("next_ts"))
    fast = (F.col("output_tokens") >= LEAST_TOKENS) & (idle < F.col("output_tokens") * 1000.0 / READ_TOKENS_PER_SECOND)
    return ends.select("project_id", "session_id", "event_key", "model_id", "output_tokens", "duration_ms", tokens_per_second(F.col("output_tokens"), F.col("duration_ms")).alias("tps"), delta_ms(F.col("asked"), F.col("ts")).alias("active_ms"), idle.alias("idle_ms"), F.coalesce(fast, F.lit(False)).alias("too_fast"))


def session_timing(turn_rows: DataFrame) -> DataFrame:
    """Turns, idle and active sums and too-fast replies of each session."""
    return turn_rows.groupBy("project_id", "session_id").agg(F.count(F.lit(1)).alias("n_turns"), F.coalesce(F.sum("idle_ms"), F.lit(0)).alias("idle_ms"), F.coalesce(F.sum("active_ms"), F.lit(0)).alias("active_ms"), F.count_if("too_fast").alias("n_too_fast"))


def session_metrics(events: DataFrame) -> DataFrame:
    """Cost, peak context use, mean rate (sum over sum, four places) and turn figures of each session."""
    timed = (F.col("event_type") == "assistant") & F.col("is_head") & (F.col("duration_ms") > 0)
    rate = F.round(F.try_divide(F.sum(F.when(timed, F.col("output_tokens"))) * 1000.0, F.sum(F.when(timed, F.col("duration_ms")))), 4)
    whole = events.groupBy("project_id", "session_id").agg(money().alias("cost_usd"), F.max("context_ratio").alias("peak_context_ratio"), rate.alias("avg_tps"))
    return whole.join(session_timing(turns(events)), ["project_id", "session_id"], "left").fillna(0, ["n_turns", "idle_ms", "active_ms", "n_too_fast"])


def performance_by_model(events: DataFrame) -> DataFrame:
    """Responses, mean rate (sum over sum), exact median rate, idle and active time of each model."""
    heads = events.where((F.col("event_type") == "assistant") & F.col("is_head") & F.col("model_id").isNotNull())
    timed = F.col("duration_ms") > 0
    mean = F.round(F.try_divide(F.sum(F.when(timed, F.col("output_tokens"))) * 1000.0, F.sum(F.when(timed, F.col("duration_ms")))), 2)
    rates = heads.withColumn("rate", F.when(timed, F.col("output_tokens") * 1000.0 / F.col("duration_ms")))
    speed = rates.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_responses"), mean.alias("avg_tps"), F.round(F.expr("percentile(rate, 0.5)"), 2).alias("median_tps"))
    spans = turns(events).groupBy("model_id").agg(F.sum("idle_ms").alias("idle_ms"), F.sum("active_ms").alias("active_ms"))
    return speed.join(spans, "model_id", "left").fillna(0, ["idle_ms", "active_ms"])


def ratio_histogram(events: DataFrame, ratio: str = "context_ratio") -> DataFrame:
    """Ten bins over [0, 1], the last one closed, empty ones kept."""
    binned = events.where(F.col(ratio).isNotNull()).groupBy(F.least(F.floor(F.col(ratio) * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = events.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(binned, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n_events"))


def timeline(events: DataFrame) -> DataFrame:
    """Each timed event's place in its session, the session's start, and the output tokens up to it."""
    order = W.partitionBy("session_id").orderBy("ts", "event_key")
    whole = W.partitionBy("session_id")
    rows = events.where(F.col("ts").isNotNull())
    return rows.select("session_id", "event_key", F.row_number().over(order).alias("seq"), F.date_format(F.min("ts").over(whole), "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.sum(F.coalesce("output_tokens", F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("running_output"))


def session_order(timeline_rows: DataFrame) -> DataFrame:
    """Sessions by start, with their largest running sum for scaling: ranges of starts are numbered apart, then moved on by the sessions of the ranges before."""
    per = timeline_rows.groupBy("session_id", "session_start").agg(F.max("running_output").alias("peak_output"))
    ranges = settled(per.repartitionByRange("session_start", "session_id").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("range").orderBy("session_start", "session_id"))
    return ranges.join(before, "range").select("session_id", "session_start", "peak_output", (nth + F.col("before")).cast("int").alias("place"))


def sessionized(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """An extra: runs of a user's events with no longer gap than this."""
    order = W.partitionBy("user_id").orderBy("ts", "event_key")
    gap = F.unix_millis(F.col("ts").cast("timestamp")) - F.lag(F.unix_millis(F.col("ts").cast("timestamp"))).over(order)
    fresh = events.withColumn("fresh", F.when(gap <= gap_minutes * 60_000, 0).otherwise(1))
    return fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_key").alias("first_event"))
