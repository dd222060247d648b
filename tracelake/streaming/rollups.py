"""Kept roll-ups behind ingest: the usage cube, of which a wave overwrites the partitions that it touches, and the sessions.

The cube is partitioned by grain and span: months, and for weeks the week. After a wave is committed, the touched months and weeks are
worked out from their events again and overwritten; the sessions that it touches get new rows in a folder of the wave, and of a
session the last row holds. Then the wave is marked as rolled up. One that has no mark is rolled up by the next call, so a cut at any
point costs a repetition and no rows. What is read for a wave are its own files as they were and are, the events of the touched
months, and of the touched sessions; none of that grows with the number of waves before.

A partition or session in which nothing is left gets a row without events, which readers drop. Events that share session and uuid are
copies of one record and carry its time, so they lie in one month.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tracelake.functions.scalars import bucket
from tracelake.operators import usage
from tracelake.streaming import ingest


def _read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def rolled_waves(spark: SparkSession, target: str) -> list[int]:
    """The waves that are rolled up; one small row each."""
    return sorted(r.wave for r in _read(spark, f"{target}/rolled", "n int, wave int").select("wave").collect())


def _months_of_week(monday: str) -> set[str]:
    first = date.fromisoformat(monday)
    return {f"m{(first + timedelta(days=k)).isoformat()[:7]}" for k in (0, 6)}


def _span(granularity: Column, at: Column) -> Column:
    """The span of a bucket: its first letters are its month."""
    return F.concat(F.lit("m"), F.when(granularity == "week", at).otherwise(F.substring(at, 1, 7)))


def _refresh_cube(spark: SparkSession, target: str, changed: DataFrame) -> None:
    timed = changed.where(F.col("ts").isNotNull())
    # the months and weeks that the few files of a wave touch
    months = {r[0] for r in timed.select(ingest.month(F.col("ts"))).distinct().collect()}
    weeks = {r[0] for r in timed.select(bucket("week", F.col("ts"))).distinct().collect()}
    if not months:
        return
    near = months.union(*map(_months_of_week, weeks))
    touched = [(g, s) for g in usage.BUCKET_FORMATS for s in sorted(f"m{w}" for w in weeks) * (g == "week") + sorted(months) * (g != "week")]
    spans = spark.createDataFrame(touched, "granularity string, span string")
    events = ingest.current_events(spark, target, F.col("month").isin(sorted(near)))
    cube = usage.cube(events).withColumn("span", _span(F.col("granularity"), F.col("bucket"))).join(F.broadcast(spans), ["granularity", "span"], "left_semi")
    rows = cube.unionByName(spans, allowMissingColumns=True).repartition("granularity", "span")
    # what is overwritten comes from the events alone, so an overwriting that was cut off is just done again
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("granularity", "span").parquet(f"{target}/cube")


_OWNERS = "session_id string, wave int"


def _refresh_sessions(spark: SparkSession, target: str, wave: int, changed: DataFrame) -> None:
    ids = changed.select("project_id", "session_id").distinct()
    ids.select("session_id").distinct().write.mode("overwrite").parquet(f"{target}/session_waves/wave={wave}")
    ids = ids.select(F.col("project_id").alias("p"), F.col("session_id").alias("s"))
    held = _read(spark, f"{target}/session_waves", _OWNERS).join(ids, F.col("session_id").eqNullSafe(F.col("s")), "left_semi")
    waves = sorted(r.wave for r in held.select("wave").distinct().collect())
    own = ingest.current_events(spark, target, F.col("wave").isin(waves)).join(ids, F.col("project_id").eqNullSafe(F.col("p")) & F.col("session_id").eqNullSafe(F.col("s")), "left_semi")
    fresh = usage.sessions(own)
    gone = ids.select(F.col("p").alias("project_id"), F.col("s").alias("session_id"))
    # a session that has lost its last event keeps the row without events
    both = fresh.unionByName(gone, allowMissingColumns=True)
    rest = [c for c in fresh.columns if c not in ("project_id", "session_id")]
    both.groupBy("project_id", "session_id").agg(*(F.max(c).alias(c) for c in rest)).write.mode("overwrite").parquet(f"{target}/sessions/wave={wave}")


def refresh(spark: SparkSession, target: str, wave: int) -> None:
    """Bring cube and sessions up to a committed wave and mark it."""
    changed = ingest.changed_events(spark, target, [wave])
    _refresh_cube(spark, target, changed)
    _refresh_sessions(spark, target, wave, changed)
    spark.createDataFrame([(1,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{target}/rolled/wave={wave}")


def kept_cube(spark: SparkSession, target: str) -> DataFrame:
    """The cube as the last wave left it, with the columns of ``usage.cube``."""
    columns = usage.cube(ingest.current_events(spark, target).limit(0))
    schema = StructType([*columns.schema.fields, StructField("span", StringType())])
    return _read(spark, f"{target}/cube", schema).where(F.col("n_events").isNotNull()).select(*columns.columns)


def kept_sessions(spark: SparkSession, target: str) -> DataFrame:
    """The sessions as the last waves left them, with the columns of ``usage.sessions``."""
    columns = usage.sessions(ingest.current_events(spark, target).limit(0))
    rest = [c for c in columns.columns if c not in ("project_id", "session_id")]
    rows = _read(spark, f"{target}/sessions", StructType([*columns.schema.fields, StructField("wave", IntegerType())])).where(F.col("wave").isin(rolled_waves(spark, target)))
    last = rows.groupBy("project_id", "session_id").agg(F.max_by(F.struct(*rest), "wave").alias("last"))
    return last.select("project_id", "session_id", "last.*").where(F.col("n_events").isNotNull()).select(*columns.columns)


def drain(spark: SparkSession, root: str, target: str, wave: int = ingest.WAVE_FILES) -> list[int]:
    """Roll up what an earlier call left, then read new and changed files and roll up each wave; the waves that were rolled up."""
    done: list[int] = []

    def roll(number: int) -> None:
        refresh(spark, target, number)
        done.append(number)

    behind = {r.wave for r in ingest.file_log(spark, target).select("wave").distinct().collect()} - set(rolled_waves(spark, target))
    for number in sorted(behind):
        roll(number)
    ingest.drain(spark, root, target, wave, after=roll)
    return done
