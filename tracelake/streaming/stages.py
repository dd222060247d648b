"""The slow steps behind ingest as stages: chunks, vectors of chunks, entities and relations, vectors of names.

A stage works on rows of the table before it whose keys its log does not have: at most ``cap`` in a run, in key order. A run
writes the keys it takes, works on those, writes its outputs and its log, each to a folder of its own, and at last one commit row,
without which none of it counts: a run that was cut off is written again under its number. ``drain`` runs every stage
until none has anything left or none gets on, also when no file has changed, so a backlog that an earlier run left is caught up.

Keys hold what a row says (an event's key with a hash of its text), so a changed text is new work, a text that came back is none,
and rows of texts that are gone drop out of the current tables: those are the outputs whose keys the table before still has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import kg_payload, search
from tracelake.streaming import ingest

#: The kinds of messages that are chunked and embedded.
EMBEDDED_KINDS = ("human",)


@dataclass(frozen=True)
class Stage:
    """``eligible`` gives the rows that there are to work on, ``work`` the outputs (name to table) for some of them; every output has the keys."""

    name: str
    keys: tuple[str, ...]
    eligible: Callable[[Store], DataFrame]
    work: Callable[[DataFrame], dict[str, DataFrame]]
    outputs: dict[str, str]
    cap: int = 0


class Store:
    """The tables of some stages under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, target: str, stages: list[Stage]):
        self.spark, self.target, self.stages = spark, target.rstrip("/"), {s.name: s for s in stages}
        self.schemas = {s.name: _keys_schema(s) for s in stages}

    def _read(self, folder: str, schema: str) -> DataFrame:
        whole = schema + ", run int"
        try:
            return self.spark.read.schema(whole).parquet(f"{self.target}/{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], whole)

    def runs(self, stage: str) -> list[int]:
        """The committed runs of a stage; one small row each."""
        return sorted(r.run for r in self._read(f"{stage}/commits", "n_keys long").select("run").collect())

    def _committed(self, stage: str, folder: str, schema: str) -> DataFrame:
        return self._read(f"{stage}/{folder}", schema).where(F.col("run").isin(self.runs(stage))).drop("run")

    def log(self, stage: str) -> DataFrame:
        """The keys that a stage has worked on."""
        return self._committed(stage, "log", self.schemas[stage])

    def output(self, stage: str, output: str) -> DataFrame:
        """All that a stage has put out, also for rows that are gone."""
        return self._committed(stage, f"out-{output}", self.stages[stage].outputs[output])

    def current(self, stage: str, output: str) -> DataFrame:
        """What a stage has put out for rows that are still there."""
        s = self.stages[stage]
        return self.output(stage, output).join(s.eligible(self).select(*s.keys).distinct(), list(s.keys), "left_semi")

    def pending(self, stage: str) -> DataFrame:
        s = self.stages[stage]
        return s.eligible(self).join(self.log(stage), list(s.keys), "left_anti")

    def step(self, stage: str) -> int:
        """One run of a stage; the number of keys that it took."""
        s = self.stages[stage]
        run = max(self.runs(stage), default=-1) + 1
        at = lambda folder: f"{self.target}/{stage}/{folder}/run={run}"
        waiting = self.pending(stage)
        if s.cap:
            some = waiting.select(*s.keys).distinct().orderBy(*s.keys).limit(s.cap)
            waiting = waiting.join(some, list(s.keys), "left_semi")
        # written first, so that outputs and log hold the same rows
        waiting.write.mode("overwrite").parquet(at("taken"))
        taken = self.spark.read.schema(waiting.schema).parquet(at("taken"))
        keys = taken.select(*s.keys).distinct()
        n = keys.count()
        if n:
            for name, rows in s.work(taken).items():
                rows.write.mode("overwrite").parquet(at(f"out-{name}"))
            keys.write.mode("overwrite").parquet(at("log"))
            self.spark.createDataFrame([(n,)], "n_keys long").coalesce(1).write.mode("overwrite").parquet(at("commits"))
        return n

    def drain(self) -> dict[str, int]:
        """Run all stages, in order, again and again until a round takes nothing; the runs that each stage needed."""
        needed = dict.fromkeys(self.stages, 0)
        while True:
            took = {name: self.step(name) for name in self.stages}
            for name, n in took.items():
                needed[name] += n > 0
            # a capped stage has a successor that may have more to do now
            if not any(took.values()):
                return needed

    def progress(self) -> DataFrame:
        """(stage, n_eligible, n_done): how far each stage is with the rows that there are."""
        rows = None
        for name, s in self.stages.items():
            there = s.eligible(self).select(*s.keys).distinct()
            done = self.log(name).withColumn("done", F.lit(1))
            one = there.join(done, list(s.keys), "left").agg(F.count(F.lit(1)).alias("n_eligible"), F.count("done").alias("n_done")).select(F.lit(name).alias("stage"), "n_eligible", "n_done")
            rows = one if rows is None else rows.unionByName(one)
        return rows


_KEY_TYPES = {"event_key": "long", "text_hash": "long", "chunk_key": "long", "name": "string"}


def _keys_schema(s: Stage) -> str:
    return ", ".join(f"{k} {_KEY_TYPES[k]}" for k in s.keys)


def chunk_rows(events: DataFrame) -> dict[str, DataFrame]:
    """The chunks of (event_key, text_hash, text); a chunk's key comes from its event, its text and its place."""
    texts = events.withColumn("event", F.struct("event_key", "text_hash"))
    cut = search.chunks(texts, "event", "text").select("event.event_key", "event.text_hash", "nth", "offset", "chunk")
    return {"chunks": cut.withColumn("chunk_key", F.xxhash64("event_key", "text_hash", "nth", "chunk"))}


def vector_rows(embedder) -> Callable[[DataFrame], dict[str, DataFrame]]:
    return lambda chunks: {"vectors": search.embed(chunks, "chunk_key", "chunk", embedder)}


def entity_rows(chunks: DataFrame) -> dict[str, DataFrame]:
    found = kg_payload.entities(chunks, "chunk_key", "chunk")
    return {"entities": found, "relations": kg_payload.line_relations(chunks, "chunk_key", "chunk")}


def name_rows(embedder) -> Callable[[DataFrame], dict[str, DataFrame]]:
    return lambda names: {"name_vectors": search.embed(names.select("name", F.lower("name").alias("low")), "name", "low", embedder)}


def text_stages(texts: Callable[[], DataFrame], *, embedder=search.hashing_embedder, name_embedder=search.letter_embedder, caps: dict[str, int] | None = None) -> list[Stage]:
    """The four stages over (event_key, text): ``texts`` gives the present rows each time that it is asked."""
    cap = (caps or {}).get
    hashed = lambda _: texts().select("event_key", F.xxhash64("text").alias("text_hash"), "text").where(F.trim("text") != "").dropDuplicates(["event_key", "text_hash"])
    chunks = lambda store: store.current("chunk", "chunks").select("chunk_key", "chunk").dropDuplicates(["chunk_key"])
    names = lambda store: store.current("entity", "entities").select("name").distinct()
    return [
        Stage("chunk", ("event_key", "text_hash"), hashed, chunk_rows, {"chunks": "event_key long, text_hash long, nth int, offset int, chunk string, chunk_key long"}, cap("chunk", 0)),
        Stage("vector", ("chunk_key",), chunks, vector_rows(embedder), {"vectors": "chunk_key long, embedding array<float>"}, cap("vector", 0)),
        Stage("entity", ("chunk_key",), chunks, entity_rows, {"entities": "chunk_key long, name string, type string", "relations": "chunk_key long, src string, dst string, rel_type string"}, cap("entity", 0)),
        Stage("name", ("name",), names, name_rows(name_embedder), {"name_vectors": "name string, embedding array<float>"}, cap("name", 0)),
    ]


def session_store(spark: SparkSession, target: str, **options) -> Store:
    """The stages over the events that ``ingest.drain`` keeps under ``target``."""
    kinds = list(EMBEDDED_KINDS)
    texts = lambda: ingest.current_events(spark, target).where(F.col("msg_kind").isin(kinds)).select("event_key", F.col("message_content").alias("text"))
    return Store(spark, f"{target}/stages", text_stages(texts, **options))


def catch_up(spark: SparkSession, root: str, target: str, wave: int = ingest.WAVE_FILES, **options) -> tuple[list[int], dict[str, int]]:
    """First all new and changed files, wave by wave, then the stages, whether a file was new or not: the waves and the runs of each stage."""
    waves = ingest.drain(spark, root, target, wave)
    if not waves and ingest.file_log(spark, target).isEmpty():
        return waves, {}
    return waves, session_store(spark, target, **options).drain()
