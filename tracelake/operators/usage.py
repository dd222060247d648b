"""Token and cost roll-ups: the additive cube and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import BUCKET_FORMATS, bucket

MEASURES = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_usd")


def units(cost: Column) -> Column:
    """A cost as a whole number of 1e-8 USD, the places that costs have; sums of these don't depend on the order of rows."""
    return F.round(cost * 1e8).cast("long")


def money(column: str = "cost_usd") -> Column:
    """The exact sum of costs."""
    return F.sum(units(F.col(column))) / 1e8


def mean_money(total: Column, n: Column, places: int = 8) -> Column:
    """A sum of units over a count, rounded half up to a number of places of USD; null for a count of 0."""
    scaled = total * 10 ** (places - 8)
    return F.floor(F.try_divide(2 * scaled + n, F.nullif(2 * n, F.lit(0)))) / 10.0**places


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in MEASURES[:-1]] + [money().alias("cost_usd")]


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    return df.withColumn("cost_usd", F.round("cost_usd", places))


def cube(events: DataFrame, grains: tuple[str, ...] = tuple(BUCKET_FORMATS)) -> DataFrame:
    """(granularity, bucket, project, session, model) with event counts and sums: grouped by hour once, coarser grains from the finer rows."""
    timed = events.where(F.col("ts").isNotNull())
    hourly = timed.groupBy(F.date_trunc("hour", "ts").alias("hour"), "project_id", "session_id", "model_id").agg(F.count(F.lit(1)).alias("n_events"), *_sums())
    stacked = hourly.select("*", F.explode(F.array(*(F.struct(F.lit(g).alias("granularity"), bucket(g, F.col("hour")).alias("bucket")) for g in grains))).alias("g")).select("g.granularity", "g.bucket", "project_id", "session_id", "model_id", "n_events", *MEASURES)
    return stacked.groupBy("granularity", "bucket", "project_id", "session_id", "model_id").agg(F.sum("n_events").alias("n_events"), *_sums())


def refreshed_cube(old: DataFrame, events: DataFrame, changed: DataFrame, grains: tuple[str, ...] = tuple(BUCKET_FORMATS)) -> DataFrame:
    """The cube after some events changed: only buckets that a changed time falls in are grouped anew."""
    hours = changed.where(F.col("ts").isNotNull())
    touched = hours.select(F.explode(F.array(*(F.struct(F.lit(g).alias("granularity"), bucket(g, F.col("ts")).alias("bucket")) for g in grains))).alias("g")).select("g.*").distinct()
    # a month has few rows of its own but many events: its rows stay where they are, and the buckets of time, few whatever the events, go to them
    touched, here = F.broadcast(touched), hours.select(bucket("month", F.col("ts")).alias("m"), bucket("week", F.col("ts")).alias("w")).distinct()
    months, weeks = F.broadcast(here.select("m").distinct()), F.broadcast(here.select("w").distinct())
    near = events.where(F.col("ts").isNotNull()).withColumn("m", bucket("month", F.col("ts"))).withColumn("w", bucket("week", F.col("ts")))
    again = near.join(months, "m", "left_semi").unionByName(near.join(months, "m", "left_anti").join(weeks, "w", "left_semi"))
    fresh = cube(again, grains).join(touched, ["granularity", "bucket"], "left_semi")
    return old.join(touched, ["granularity", "bucket"], "left_anti").unionByName(fresh)


def usage_by(events: DataFrame, grain: str, keys: tuple[str, ...] = ("project_id", "model_id")) -> DataFrame:
    """Sums for each bucket and key."""
    grouped = events.where(F.col("ts").isNotNull()).groupBy(*keys, bucket(grain, F.col("ts")).alias("bucket"))
    return rounded(grouped.agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("session_id").alias("n_sessions"), *_sums()))


def usage_hourly(events: DataFrame) -> DataFrame:
    """Sums for each project, date and hour of day."""
    hour = events.where(F.col("ts").isNotNull()).groupBy("project_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.hour("ts").alias("hour"))
    return rounded(hour.agg(F.count(F.lit(1)).alias("n_events"), *_sums()))


def usage_summary(events: DataFrame) -> DataFrame:
    """Totals over all events."""
    return rounded(events.agg(F.countDistinct("project_id").alias("n_projects"), F.countDistinct("session_id").alias("n_sessions"), F.count(F.lit(1)).alias("n_events"), *_sums()))


def session_usage(events: DataFrame) -> DataFrame:
    """Sums and first and last time for each project, session and model."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rounded(events.groupBy("project_id", "session_id", "model_id").agg(F.count(F.lit(1)).alias("n_events"), text(F.min("ts")).alias("first_ts"), text(F.max("ts")).alias("last_ts"), *_sums()))


def projects(sessions: DataFrame) -> DataFrame:
    """Sums of sessions for each project."""
    return rounded(sessions.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), money().alias("cost_usd")))


def sessions(events: DataFrame) -> DataFrame:
    """One row for each session: events, subagents (agents less the main one, not below 0), first and last time, cost."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    grouped = events.groupBy("project_id", "session_id").agg(F.count(F.lit(1)).alias("n_events"), F.greatest(F.lit(0), F.countDistinct("agent_id") - 1).alias("n_subagents"), text(F.min("ts")).alias("first_ts"), text(F.max("ts")).alias("last_ts"), money().alias("cost_usd"))
    return rounded(grouped)


def top_projects_weekly(events: DataFrame, top: int = 3) -> DataFrame:
    """The dearest projects by week, with the cost for each session."""
    best = events.groupBy("project_id").agg(money().alias("total")).orderBy(F.desc("total"), "project_id").limit(top).select("project_id")
    # the other side has ``top`` rows
    weeks = events.where(F.col("ts").isNotNull()).join(F.broadcast(best), "project_id").groupBy("project_id", bucket("week", F.col("ts")).alias("bucket")).agg(F.countDistinct("session_id").alias("n_sessions"), F.sum(units(F.col("cost_usd"))).alias("units"))
    return weeks.withColumn("cost_usd", F.col("units") / 1e8).withColumn("cost_per_session", mean_money(F.col("units"), F.col("n_sessions"))).drop("units")


def sessions_a_day(events: DataFrame) -> DataFrame:
    """Sessions of each project and their number a day, over seven days for each week that has any."""
    per = events.where(F.col("ts").isNotNull()).groupBy("project_id").agg(F.countDistinct("session_id").alias("n_sessions"), F.countDistinct(bucket("week", F.col("ts"))).alias("n_weeks"))
    return per.withColumn("per_day", F.round(F.col("n_sessions") * 1.0 / (F.col("n_weeks") * 7), 4))


def rolling_cost(events: DataFrame, grain: str = "day", buckets: int = 7) -> DataFrame:
    """Cost of each bucket and its mean over the last ``buckets`` buckets that are present."""
    per = events.where(F.col("ts").isNotNull()).groupBy(bucket(grain, F.col("ts")).alias("bucket")).agg(F.sum(units(F.col("cost_usd"))).alias("units"))
    # a row a bucket of time: few, whatever the events
    trailing = W.orderBy("bucket").rowsBetween(1 - buckets, 0)
    rolling = mean_money(F.sum("units").over(trailing), F.count(F.lit(1)).over(trailing))
    return per.select("bucket", (F.col("units") / 1e8).alias("cost_usd"), rolling.alias("rolling_cost"))


def day_hour_matrix(events: DataFrame) -> DataFrame:
    """Mean cost by weekday (Monday 0) and hour over the days that have any; all 168 cells."""
    cells = events.where(F.col("ts").isNotNull()).groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.sum(units(F.col("cost_usd"))).alias("cost"))
    means = cells.where("cost > 0").groupBy(F.weekday("date").alias("weekday"), "hour").agg(mean_money(F.sum("cost"), F.count(F.lit(1)), 9).alias("mean_cost"))
    grid = events.sparkSession.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(means, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("mean_cost", F.lit(0.0)).alias("mean_cost"))


def hour_heatmap(events: DataFrame) -> DataFrame:
    """Events by date, one column for each hour of day."""
    hours = [f"h{h:02d}" for h in range(24)]
    named = events.where(F.col("ts").isNotNull()).select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("h"), F.date_format("ts", "HH")).alias("hour"))
    return named.groupBy("date").pivot("hour", hours).agg(F.count(F.lit(1))).fillna(0, hours)


def call_ratio(n_events: Column, n_calls: Column) -> Column:
    """Calls in a hundred events, one decimal."""
    return F.round(F.try_divide(n_calls * 100.0, F.nullif(n_events, F.lit(0))), 1)


def sessions_list(events: DataFrame, calls: DataFrame, call_types: list[str], skill_type: str) -> DataFrame:
    """Sessions with call counts by type and their most frequent skill, ties by name."""
    counts = calls.groupBy("project_id", "session_id").agg(*(F.count_if(F.col("call_type") == t).alias(f"n_{t}") for t in call_types))
    skills = calls.where(F.col("call_type") == skill_type).groupBy("project_id", "session_id", "call_name").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("project_id", "session_id").orderBy(F.desc("n"), "call_name"))
    top = skills.withColumn("rank", rank).where("rank = 1").select("project_id", "session_id", F.col("call_name").alias("top_skill"))
    keys = ["project_id", "session_id"]
    joined = sessions(events).join(counts, keys, "left").join(top, keys, "left").fillna(0, [f"n_{t}" for t in call_types])
    return joined.withColumn("calls_per_100", call_ratio(F.col("n_events"), sum((F.col(f"n_{t}") for t in call_types[1:]), F.col(f"n_{call_types[0]}"))))


def modal_skill(sessions_with_skill: DataFrame) -> DataFrame:
    """Each project's most frequent top skill among its sessions, ties by name."""
    counts = sessions_with_skill.where(F.col("top_skill").isNotNull()).groupBy("project_id", "top_skill").agg(F.count(F.lit(1)).alias("n_sessions"))
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("n_sessions"), "top_skill"))
    return counts.withColumn("rank", rank).where("rank = 1").drop("rank")
