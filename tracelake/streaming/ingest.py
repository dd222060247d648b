"""Transcripts as files that come and change: waves of a bounded number of files.

``ingest`` streams files that appear and never change. ``drain`` reads what is new or has changed, appended, shrunk or
replaced, wave after wave until nothing is left: each wave writes the events of its files to a folder of its own and then its
files to a log, which commits it; a wave that was cut off is written again. The events of a file are those of its last wave.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators.incremental import null_safe_missing
from tracelake.sources.transcripts import changed_files, discover, first_of_uuid, lines_of, mark_responses, parse_events, raw_lines

WAVE_FILES = 50


def stream_files(spark: SparkSession, root: str, wave: int = WAVE_FILES) -> DataFrame:
    """Whole transcript files as they appear, ``wave`` at a time."""
    return spark.readStream.option("maxFilesPerTrigger", wave).text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select("value", F.col("_metadata"))


def ingest(spark: SparkSession, root: str, target: str, checkpoint: str, wave: int = WAVE_FILES) -> StreamingQuery:
    """Append each wave's events to Parquet at ``target``, one folder a wave, without events whose (session, uuid) is there already.

    A wave that is run again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, wave_id: int) -> None:
        events = first_of_uuid(mark_responses(parse_events(lines_of(batch, root)))).drop("blocks")
        if wave_id:
            known = spark.read.parquet(*(f"{target}/wave={k}" for k in range(wave_id)))
            with_id = events.where(F.col("event_uuid").isNotNull())
            events = null_safe_missing(with_id, known, ["session_id", "event_uuid"]).unionByName(events.where(F.col("event_uuid").isNull()))
        events.write.mode("overwrite").parquet(f"{target}/wave={wave_id}")

    return stream_files(spark, root, wave).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_LOG = "file_path string, mtime timestamp, size long, wave int"


def month(ts: Column) -> Column:
    """The partition of a time, such as ``m2025-11``, which no reader takes for a date."""
    return F.date_format(ts, "'m'yyyy-MM")


def file_log(spark: SparkSession, target: str) -> DataFrame:
    """(file_path, mtime, size, wave) of every file as each wave read it."""
    try:
        return spark.read.parquet(f"{target}/files").select("file_path", "mtime", "size", F.col("wave").cast("int"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def last_read(log: DataFrame) -> DataFrame:
    """The log's last row of each file."""
    return log.groupBy("file_path").agg(F.max(F.struct("wave", "mtime", "size")).alias("last")).select("file_path", "last.mtime", "last.size", "last.wave")


def drain(spark: SparkSession, root: str, target: str, wave: int = WAVE_FILES, after: Callable[[int], None] | None = None) -> list[int]:
    """Read new and changed files until none is left; the numbers of the waves that it took. A wave reads its own files and the log, no earlier events; ``after`` is called with each wave that is committed."""
    done: list[int] = []
    while True:
        log = file_log(spark, target)
        todo = changed_files(discover(spark, root), last_read(log)).select("file_path", "mtime", "size").orderBy("file_path").limit(wave).collect()  # at most ``wave`` rows
        if not todo:
            return done
        number = (log.agg(F.max("wave")).first()[0] if not done else done[-1]) if done or not log.isEmpty() else -1
        number += 1
        events = mark_responses(parse_events(raw_lines(spark, root, [unquote(r.file_path) for r in todo]))).drop("blocks")
        # by month, so that a roll-up of some months reads no others
        events.withColumn("month", month(F.col("ts"))).write.mode("overwrite").partitionBy("month").parquet(f"{target}/events/wave={number}")
        spark.createDataFrame([tuple(r) for r in todo], "file_path string, mtime timestamp, size long").coalesce(1).write.mode("overwrite").parquet(f"{target}/files/wave={number}")
        done.append(number)
        if after:
            after(number)


def current_events(spark: SparkSession, target: str, where: Column | None = None) -> DataFrame:
    """The events of all files as they were last read, one for each (session, uuid); ``where`` picks among the partitions (wave, month) that are read."""
    last = last_read(file_log(spark, target)).select("file_path", "wave")
    rows = spark.read.parquet(f"{target}/events")
    rows = rows if where is None else rows.where(where)
    return first_of_uuid(rows.join(last, ["file_path", "wave"], "left_semi").drop("wave", "month"))


def changed_events(spark: SparkSession, target: str, waves: list[int]) -> DataFrame:
    """The events, old and new, of the files that some waves read: what a roll-up has to be refreshed for."""
    log = file_log(spark, target)
    files = log.where(F.col("wave").isin(waves)).select("file_path").distinct()
    # the waves in which these files were read
    held = sorted(r.wave for r in log.join(files, "file_path", "left_semi").select("wave").distinct().collect())
    return spark.read.parquet(f"{target}/events").where(F.col("wave").isin(held)).join(files, "file_path", "left_semi").drop("wave", "month")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extra: tumbling-window counts and costs of a stream of events, late rows dropped by a watermark."""
    timed = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "project_id")
    return timed.agg(F.count(F.lit(1)).alias("n_events"), F.sum("cost_usd").alias("cost_usd")).select(F.col("w.start").alias("start"), "project_id", "n_events", "cost_usd")
