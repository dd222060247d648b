"""An evaluation grid: summary models by merge strategies by time grains, scored against what people really wrote, and ranked.

A cell is one model, strategy and grain. Each model summarises the sessions once; each strategy rolls these up for all grains that it
still lacks in one pass. Two things are scored: a session's summary against the session's own texts (what tells models apart), and
a scope's roll-ups, joined in bucket order, against all texts below the scope (what tells strategies apart). The means are the cell's
record. Records are written by model and strategy, one partition a cell, so a run that was cut off takes up with the cells that have none.

Failures are data: a session or scope whose engine raises a ``ValueError`` or ``KeyError`` or says nothing has no summary, counts in
``n_failed`` and makes the cell's status ``error``. Sessions without texts, scopes or times are left out; a cell in which nothing
could be scored has null means and ranks as 0. Models that are not there stay in the grid as not available.

The sessions are an evaluation set: the texts below a scope are compared in order, so a scored scope's texts meet in one row.
``least_depth`` leaves scopes nearer to the root unscored, which keeps that row small where the set is large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.scalars import ancestors, scope_depth
from tracelake.operators import claims, search, summaries, text_metrics
from tracelake.sources.scratch import settled

METRICS = (*text_metrics.SCORES, "embed_cosine")
#: The measures whose mean ranks the cells.
RANKED_BY = ("rouge_l", "bleu", "f1")

_CELL = ("model", "strategy", "grain")
_RECORD = ", ".join(
    ["status string", "n_failed long", "rollup_rows long", "n_sessions_scored long", "n_rollups_scored long", "source_sessions long", "source_texts long", "source_tokens long"]
    + [f"{of}_{m} double" for of in ("session", "rollup") for m in METRICS]
    + [f"{c} string" for c in _CELL]
)


@dataclass(frozen=True)
class Model:
    """A summary model: its size, by which the grid is worked off, and its engine, None where it isn't available."""

    size: float
    engine: summaries.Engine | None


def permutation_id() -> Column:
    return F.concat_ws("__", *_CELL)


def records(spark: SparkSession, target: str) -> DataFrame:
    """The records of the cells that are done."""
    try:
        return spark.read.schema(_RECORD).parquet(f"{target}/records")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _RECORD)


def cells(spark: SparkSession, target: str, models: dict[str, Model], strategies: list[str], grains: list[str]) -> DataFrame:
    """(permutation_id, model, size, strategy, grain, available, done), the smallest models first."""
    rows = [(m, float(v.size), s, g, v.engine is not None) for m, v in models.items() for s in strategies for g in grains]
    made = spark.createDataFrame(rows, "model string, size double, strategy string, grain string, available boolean")
    done = records(spark, target).select(*_CELL, F.lit(True).alias("done"))
    joined = made.join(done, list(_CELL), "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return joined.select(permutation_id().alias("permutation_id"), "model", "size", "strategy", "grain", "available", "done").orderBy("size", *_CELL)


def _quiet(engine: summaries.Engine) -> summaries.Engine:
    """The engine with an empty reply where it fails."""

    def reply(prompt: str) -> str:
        try:
            return engine(prompt) or ""
        except (ValueError, KeyError):
            return ""

    return reply


def _sources(events: DataFrame, scopes: DataFrame) -> DataFrame:
    """(session_key, project_id, session_id, scope, texts, content_hash, source) of the sessions that can be placed and say something."""
    placed = claims.session_texts(events).join(scopes.where("scope IS NOT NULL").select("project_id", "scope"), "project_id")
    source = placed.withColumn("source", F.array_join("texts", "\n")).where(F.trim("source") != "")
    return source.withColumn("session_key", F.concat_ws("/", "project_id", "session_id"))


def _summarised(sources: DataFrame, engine: summaries.Engine) -> DataFrame:
    """(session_key, summary); the empty text where the engine failed."""
    reply = _quiet(engine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [reply("\n\n".join(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["session_key", "summary"])

    return sources.select("session_key", "texts").mapInArrow(run, "session_key string, summary string")


def _scored(pairs: DataFrame, embedder) -> DataFrame:
    """All measures of (key, text, reference) rows."""
    lexical = text_metrics.scored(pairs, "key", "text", "reference")
    mine, theirs = search.embed(pairs, "key", "text", embedder), search.embed(pairs, "key", "reference", embedder).withColumnRenamed("embedding", "other")
    near = mine.join(theirs, "key").select("key", F.coalesce(F.nanvl(1 - search.cosine_distance(F.col("embedding"), F.col("other")), F.lit(0.0)), F.lit(0.0)).alias("embed_cosine"))
    return lexical.join(near, "key")


def _means(of: str) -> list[Column]:
    return [F.count(F.lit(1)).alias(f"n_{of}s_scored"), *(F.avg(m).alias(f"{of}_{m}") for m in METRICS)]


def run_grid(events: DataFrame, scopes: DataFrame, target: str, models: dict[str, Model], *, strategies: list[str] | None = None, grains: tuple[str, ...] = ("day", "week", "month"), embedder=search.hashing_embedder, least_depth: int = 0) -> int:
    """Work off the cells that have no record, the smallest models first; the number of cells that were."""
    spark = events.sparkSession
    for s in strategies or []:
        summaries.merger(s)
    # a few cells, not data
    grid = cells(spark, target, models, strategies or sorted(summaries.MERGERS), list(grains)).where("available AND NOT done").orderBy("size", *_CELL).collect()
    if not grid:
        return 0
    sources = settled(_sources(events, scopes), "grid-sources")
    tokens = F.size(F.regexp_extract_all(F.lower("source"), F.lit(r"(?U)\w+"), F.lit(0)))
    facts = sources.agg(F.count(F.lit(1)).alias("source_sessions"), F.coalesce(F.sum(F.size("texts")), F.lit(0)).cast("long").alias("source_texts"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("source_tokens"))
    wanted = sorted({c.grain for c in grid})
    spans = None
    for grain in wanted:
        one = claims.session_buckets(events, grain).select(F.concat_ws("/", "project_id", "session_id").alias("session_key"), F.lit(grain).alias("grain"), "bucket")
        spans = one if spans is None else spans.unionByName(one)
    spans = settled(spans, "grid-spans")
    below = sources.select(F.explode(ancestors(F.col("scope"))).alias("scope"), "session_key", "source").where(scope_depth(F.col("scope")) >= least_depth)
    in_order = lambda rows, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda r: r[by[-1]]), rows)
    references = settled(below.groupBy("scope").agg(in_order("\n", ["session_key", "source"]).alias("reference")), "grid-references")
    for model in dict.fromkeys(c.model for c in grid):
        engine = models[model].engine
        made = settled(sources.select("session_key", "scope", "content_hash", "source").join(_summarised(sources, engine), "session_key"), "grid-summaries")
        good = made.where("summary <> ''")
        own = _scored(good.select(F.col("session_key").alias("key"), F.col("summary").alias("text"), F.col("source").alias("reference")), embedder).agg(*_means("session"))
        lost = made.where("summary = ''").agg(F.count(F.lit(1)).alias("lost"))
        # one row
        common = settled(own.join(F.broadcast(facts), how="cross").join(F.broadcast(lost), how="cross"), "grid-model")
        for strategy in dict.fromkeys(c.strategy for c in grid if c.model == model):
            open_grains = [c.grain for c in grid if c.model == model and c.strategy == strategy]
            rows = good.join(spans.where(F.col("grain").isin(open_grains)), "session_key")
            # all grains in one pass: the bucket carries its grain
            dated = rows.select(F.col("session_key").alias("session_id"), "content_hash", "scope", F.concat_ws("|", "grain", "bucket").alias("bucket"), "summary")
            excerpts = None
            if summaries.MERGERS[strategy].with_excerpts:
                for grain in open_grains:
                    one = claims.excerpts(claims.excerpt_candidates(events, scopes, grain)).select("scope", F.concat_ws("|", F.lit(grain), "bucket").alias("bucket"), "text")
                    excerpts = one if excerpts is None else excerpts.unionByName(one)
            rolled = settled(summaries.roll_up(dated, strategy, _quiet(engine), excerpts=excerpts).withColumn("grain", F.substring_index("bucket", "|", 1)), "grid-rollups")
            said = rolled.where("summary <> ''").groupBy("grain", "scope").agg(in_order(" ", ["bucket", "summary"]).alias("text"))
            pairs = settled(said.join(references, "scope").select(F.to_json(F.struct("grain", "scope")).alias("key"), "text", "reference"), "grid-pairs")
            scores = _scored(pairs, embedder).groupBy(F.get_json_object("key", "$.grain").alias("grain")).agg(*_means("rollup"))
            sizes = rolled.groupBy("grain").agg(F.count(F.lit(1)).alias("rollup_rows"), F.count_if(F.col("summary") == "").alias("empty"))
            done = spark.createDataFrame([(g,) for g in open_grains], "grain string").join(F.broadcast(common), how="cross").join(sizes, "grain", "left").join(scores, "grain", "left")
            failed = F.col("lost") + F.coalesce("empty", F.lit(0))
            done = done.fillna(0, ["rollup_rows", "n_rollups_scored"]).withColumn("n_failed", failed).withColumn("status", F.when(failed > 0, "error").otherwise("ok"))
            done = done.withColumn("model", F.lit(model)).withColumn("strategy", F.lit(strategy)).select(*records(spark, target).columns)
            done.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_CELL).parquet(f"{target}/records")
    return len(grid)


def ranked(spark: SparkSession, target: str) -> DataFrame:
    """The records with their ``permutation_id`` and ``combined``, best first, ties by id; a cell without a scored roll-up has 0, whatever its sessions score."""
    combined = sum((F.col(f"rollup_{m}") for m in RANKED_BY), F.lit(0.0)) / len(RANKED_BY)
    rows = records(spark, target).withColumn("permutation_id", permutation_id())
    return rows.withColumn("combined", F.when(F.col("n_rollups_scored") > 0, combined).otherwise(0.0)).orderBy(F.desc("combined"), "permutation_id")
