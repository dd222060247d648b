"""What is new: unprocessed rows, first-wins repeats, null-safe look-ups, run comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unprocessed(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the log doesn't have."""
    return rows.join(log.select(*keys), keys, "left_anti")


def within_window(rows: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among the active ones."""
    return rows.join(active.select(*keys), keys, "left_semi")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in an order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def replaced_by_file(old: DataFrame, new: DataFrame, file_column: str = "file_path") -> DataFrame:
    """Old rows of files that were read again go; the new ones take their place."""
    return old.join(new.select(file_column).distinct(), file_column, "left_anti").unionByName(new)


def null_safe_missing(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no known row equals in all keys, nulls being equal."""
    other = known.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(other, same, "left_anti")


def stage_stats(eligible: DataFrame, done: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """(stage, n_eligible, n_done, n_pending, pct): progress of one stage, done no more than eligible."""
    e = eligible.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_eligible"))
    d = done.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n"))
    # one row each
    both = e.join(F.broadcast(d), how="cross").select(F.lit(stage).alias("stage"), "n_eligible", F.least("n", "n_eligible").alias("n_done"))
    return both.withColumn("n_pending", F.col("n_eligible") - F.col("n_done")).withColumn("pct", F.round(F.coalesce(F.try_divide(F.col("n_done") * 100.0, F.col("n_eligible")), F.lit(100.0)), 1))


def latency_table(calls: DataFrame, endpoint: str, ms: str) -> DataFrame:
    """p50, p95, p99 and maximum of each endpoint, nearest rank. Equal times are counted before they meet, so a busy endpoint brings one row for each different time."""
    times = calls.groupBy(endpoint, ms).agg(F.count(F.lit(1)).alias("same"))
    upto = F.sum("same").over(W.partitionBy(endpoint).orderBy(ms).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = times.withColumn("upto", upto).withColumn("n", F.sum("same").over(W.partitionBy(endpoint)))
    at = lambda p: F.min_by(ms, F.when(F.col("upto") >= F.least(F.col("n"), F.floor(F.col("n") * p) + 1), F.col("upto")))
    return ranked.groupBy(endpoint).agg(F.max("n").alias("n_calls"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(ms).alias("max_ms"))


def regressions(before: DataFrame, after: DataFrame, endpoint: str, threshold: float = 0.1) -> DataFrame:
    """Endpoints whose p95 grew by more than a threshold."""
    old = before.select(endpoint, F.col("p95").alias("p95_before"))
    joined = after.select(endpoint, F.col("p95").alias("p95_after")).join(old, endpoint)
    return joined.withColumn("regressed", F.col("p95_after") > F.col("p95_before") * (1 + threshold))
