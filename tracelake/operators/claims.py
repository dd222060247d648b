"""Claims and summaries over a scope hierarchy: roll-ups, coverage, failures, cluster trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import ancestors, bucket, content_hash, failure_category, normal_claim

#: Texts of a cluster that a name is made from, and excerpts of a roll-up.
NAMED_FROM, EXCERPTS = 40, 20
#: Fixed value: concepts below which every concept is a cluster of its own.
LEAST_CONCEPTS = 16


def session_buckets(events: DataFrame, grain: str) -> DataFrame:
    """(project_id, session_id, bucket): the bucket that a session begins in."""
    return events.where(F.col("ts").isNotNull()).groupBy("project_id", "session_id").agg(F.min("ts").alias("first")).select("project_id", "session_id", bucket(grain, F.col("first")).alias("bucket"))


def with_scopes(rows: DataFrame, scope: str = "scope") -> DataFrame:
    """Each row once for every scope that its own lies in, the root first."""
    return rows.withColumn(scope, F.explode(ancestors(F.col(scope))))


def claim_rollup(claims: DataFrame, buckets: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, bucket, lens, claim, n_sessions, session_ids, place): distinct sessions of each claim in each scope and bucket, ranked; empty claims are none."""
    placed = claims.withColumn("claim", normal_claim(F.col("claim"))).where("lens IS NOT NULL AND claim <> ''").select("project_id", "session_id", "lens", "claim").distinct().join(buckets, ["project_id", "session_id"]).join(scopes, "project_id")
    grouped = with_scopes(placed).groupBy("scope", "bucket", "lens", "claim").agg(F.countDistinct("session_id").alias("n_sessions"), F.to_json(F.array_sort(F.collect_set("session_id"))).alias("session_ids"))
    rank = W.partitionBy("scope", "bucket", "lens").orderBy(F.desc("n_sessions"), "claim")
    return grouped.withColumn("place", F.row_number().over(rank) - 1)


def claim_union(rollup: DataFrame) -> DataFrame:
    """Claims united over buckets: the sessions of the same claim are counted once."""
    sessions = rollup.select("scope", "lens", "claim", F.explode(F.from_json("session_ids", "array<string>")).alias("session_id"))
    return sessions.groupBy("scope", "lens", "claim").agg(F.countDistinct("session_id").alias("n_sessions"))


def memberships(rollup: DataFrame, session_id: str) -> DataFrame:
    """Scopes and buckets whose claims name a session."""
    named = rollup.where(F.array_contains(F.from_json("session_ids", "array<string>"), session_id))
    return named.groupBy("scope", "bucket").agg(F.count(F.lit(1)).alias("n_claims"))


def coverage(sessions: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """Sessions of each project that are done, failed and pending, and the share done."""
    keys = ["project_id", "session_id"]
    one = sessions.select(*keys).distinct().join(done.select(*keys).distinct().withColumn("done", F.lit(1)), keys, "left").join(failed.select(*keys).distinct().withColumn("failed", F.lit(1)), keys, "left")
    is_done = F.col("done").isNotNull()
    grouped = one.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(is_done).alias("done"), F.count_if(F.col("failed").isNotNull() & ~is_done).alias("failed"))
    return grouped.withColumn("pending", F.col("total") - F.col("done") - F.col("failed")).withColumn("pct", F.round(F.try_divide(F.col("done") * 100.0, F.col("total")), 1))


def coverage_pivot(buckets: DataFrame, scopes: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """(scope, bucket, n_sessions, n_done, n_failed, status): 2 complete, 1 in part, 0 none."""
    keys = ["project_id", "session_id"]
    one = buckets.join(scopes, "project_id").join(done.select(*keys).distinct().withColumn("done", F.lit(1)), keys, "left").join(failed.select(*keys).distinct().withColumn("failed", F.lit(1)), keys, "left")
    grouped = with_scopes(one).groupBy("scope", "bucket").agg(F.count(F.lit(1)).alias("n_sessions"), F.count("done").alias("n_done"), F.count("failed").alias("n_failed"))
    status = F.when(F.col("n_done") == F.col("n_sessions"), 2).when(F.col("n_done") > 0, 1).otherwise(0)
    return grouped.withColumn("status", status)


def dense_heatmap(pivot: DataFrame) -> DataFrame:
    """All scopes by all buckets, the missing ones with status 0. The bucket side is one row for each period."""
    grid = pivot.select("scope").distinct().join(F.broadcast(pivot.agg(F.array_sort(F.collect_set("bucket")).alias("all"))).select(F.explode("all").alias("bucket")), how="cross")
    return grid.join(pivot.select("scope", "bucket", "status"), ["scope", "bucket"], "left").fillna(0, ["status"])


def failure_analysis(failures: DataFrame, samples: int = 5) -> DataFrame:
    """Failures of each category, their share and the first few reasons."""
    named = failures.withColumn("category", failure_category(F.col("reason"), F.col("raw_excerpt")))
    first = W.partitionBy("category").orderBy("reason", "session_id")
    some = named.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= samples).groupBy("category").agg(F.array_sort(F.collect_list("reason")).alias("samples"))
    counts = named.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 1)
    return counts.withColumn("pct", share).join(some, "category")


def failure_rollup(failures: DataFrame, buckets: DataFrame, scopes: DataFrame) -> DataFrame:
    placed = failures.select("project_id", "session_id").distinct().join(buckets, ["project_id", "session_id"]).join(scopes, "project_id")
    return with_scopes(placed).groupBy("scope", "bucket").agg(F.countDistinct("session_id").alias("n_sessions"))


def plurality_parents(members: DataFrame) -> DataFrame:
    """(fine, coarse): the coarse cluster that most members of a fine one are in, ties to the least; noise (-1) has none."""
    counts = members.where("fine >= 0 and coarse >= 0").groupBy("fine", "coarse").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("fine").orderBy(F.desc("n"), "coarse"))
    best = counts.withColumn("rank", rank).where("rank = 1").select("fine", "coarse")
    return members.where("fine >= 0").select("fine").distinct().join(best, "fine", "left")


def select_layers(n_layers: int, persistence: list[float]) -> tuple[int, int]:
    """(coarse, fine) layers, counted from the finest one: the most persistent layer is fine and the next coarser one coarse; the coarsest itself can't be fine, so its finer neighbour is. Ties go to the finer layer."""
    if n_layers <= 1:
        return 0, 0
    best = max(range(n_layers), key=lambda k: (persistence[k], -k))
    fine = min(best, n_layers - 2)
    return fine + 1, fine


def cluster_tree(leaves: DataFrame) -> DataFrame:
    """(lens, coarse, fine, n_leaves, n_sessions) from leaves with their cluster names and session arrays; leaves of no cluster are ``Unclustered``."""
    named = leaves.select("lens", F.coalesce("coarse", F.lit("Unclustered")).alias("coarse"), F.coalesce("fine", F.lit("Unclustered")).alias("fine"), "claim", F.explode("sessions").alias("session_id"))
    return named.groupBy("lens", "coarse", "fine").agg(F.countDistinct("claim").alias("n_leaves"), F.countDistinct("session_id").alias("n_sessions"))


def member_texts(members: DataFrame, most: int = NAMED_FROM) -> DataFrame:
    """The most frequent claim texts of each cluster."""
    counts = members.groupBy("cluster", "claim").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "claim"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def session_texts(events: DataFrame) -> DataFrame:
    """(project_id, session_id, texts, content_hash): a session's human texts in order and their hash."""
    human = events.where((F.col("msg_kind") == "human") & (F.coalesce("message_content", F.lit("")) != ""))
    grouped = human.groupBy("project_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_key", "message_content"))).alias("rows"))
    texts = F.transform("rows", lambda r: r["message_content"])
    return grouped.select("project_id", "session_id", texts.alias("texts"), content_hash(texts).alias("content_hash"))


def pending(texts: DataFrame, summaries: DataFrame, model: str) -> DataFrame:
    """Sessions that have no summary by a model of their present content."""
    return texts.join(summaries.where(F.col("model") == model), ["project_id", "session_id", "content_hash"], "left_anti")


def summarise(texts: DataFrame, engine: Callable[[str], str], model: str) -> DataFrame:
    """Summaries by a pluggable engine; texts are joined by blank lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [engine("\n\n".join(t or [])) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(made, pa.string())], ["project_id", "session_id", "content_hash", "summary"])

    rows = texts.select("project_id", "session_id", "texts", "content_hash").mapInArrow(run, "project_id string, session_id string, content_hash string, summary string")
    return rows.withColumn("model", F.lit(model))


def lead_engine(text: str) -> str:
    """The offline stand-in for a summary model: the first sentences, up to 400 characters."""
    return text[:400].rpartition(".")[0] + "." if "." in text[:400] else text[:400]


def excerpt_candidates(events: DataFrame, scopes: DataFrame, grain: str) -> DataFrame:
    """(scope, bucket, ts, text): what people said, for every scope that the project lies in and every bucket of a grain; projects without a scope and messages without a text or time are left out.

    ``excerpts`` takes the first few of each group; Spark limits the groups before it shuffles them, so the root, which sees all, is no hot group.
    """
    said = events.where((F.col("msg_kind") == "human") & F.col("message_content").isNotNull() & F.col("ts").isNotNull())
    placed = said.join(scopes.where(F.col("scope").isNotNull()).select("project_id", "scope"), "project_id")
    return with_scopes(placed.select("scope", bucket(grain, F.col("ts")).alias("bucket"), "ts", F.col("message_content").alias("text")))


def excerpts(candidates: DataFrame, most: int = EXCERPTS) -> DataFrame:
    """The latest, then longest, excerpts of each scope and bucket."""
    rank = F.row_number().over(W.partitionBy("scope", "bucket").orderBy(F.desc("ts"), F.desc(F.length("text")), F.desc("text")))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= most)


def scope_rollup(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Measures of every scope of a hierarchy from rows at its leaves."""
    return with_scopes(rows).groupBy("scope").agg(*(c.alias(n) for n, c in measures.items()))
