"""Sinks beside tables: benchmark records as JSON, ranked again on reading, and roll-ups as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.kg_payload import combined_score

RECORD = "permutation_id string, n_rollups_scored long, rollup_rouge_l double, rollup_bleu double, rollup_f1 double"


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def ranked_records(spark: SparkSession, path: str) -> DataFrame:
    """All records, the best first, ties by id."""
    rows = spark.read.schema(RECORD).json(path).fillna(0)
    score = combined_score(F.col("rollup_rouge_l"), F.col("rollup_bleu"), F.col("rollup_f1"), F.col("n_rollups_scored"))
    return rows.withColumn("combined", score).orderBy(F.desc("combined"), "permutation_id")


def markdown(rollups: DataFrame) -> DataFrame:
    """(scope, bucket, line) rows of a Markdown dump, in order; write them with ``write.text``."""
    title = F.concat(F.lit("## "), F.when(F.col("scope") == "", "(all)").otherwise(F.col("scope")), F.lit(" "), F.col("bucket"))
    return rollups.orderBy("scope", "bucket").select("scope", "bucket", F.concat_ws("\n\n", title, "summary").alias("line"))


def fitting_share(sizes: DataFrame, key: str, tokens: str, candidates: list[int]) -> DataFrame:
    """Percentiles of prompt sizes and the share that fits each context size, for each key."""
    shares = [F.round(F.avg((F.col(tokens) <= c).cast("double")) * 100, 2).alias(f"fits_{c}") for c in candidates]
    return sizes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"percentile({tokens}, {p})").alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)), *shares)
