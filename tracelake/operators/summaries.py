"""Roll-ups of session summaries along a scope hierarchy, by pluggable merge strategies, and claim extraction."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.model_output import claim_lists
from tracelake.functions.scalars import ancestors, content_hash, parent_scope, scope_depth

#: Fixed value: characters that a text must have to be split.
LEAST_SPLIT = 400
#: A summary engine: a prompt to a text.
Engine = Callable[[str], str]


@dataclass(frozen=True)
class Merger:
    """How a scope's summary comes from others: from its child scopes or from all sessions below it, with raw excerpts or not."""

    name: str
    from_sessions: bool = False
    with_excerpts: bool = False


MERGERS = {m.name: m for m in (Merger("strict"), Merger("reground", with_excerpts=True), Merger("flat", from_sessions=True))}


def merger(name: str) -> Merger:
    if name not in MERGERS:
        raise KeyError(f"unknown merge strategy {name!r}; there are {sorted(MERGERS)}")
    return MERGERS[name]


def merged(children: DataFrame, engine: Engine) -> DataFrame:
    """(scope, bucket, summary, child_count, source_hash) from (scope, bucket, texts, keys, excerpts) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts, excerpts in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                prompt = "\n\n".join(f"Child {n}: {t}" for n, t in enumerate(texts, 1))
                if excerpts:
                    prompt += "\n\nSource excerpts:\n" + "\n".join(f"- {e}" for e in excerpts)
                out.append(engine(prompt))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), batch.column(3), batch.column(4)], ["scope", "bucket", "summary", "child_count", "source_hash"])

    rows = children.select("scope", "bucket", "texts", F.size("texts").alias("child_count"), content_hash(F.col("keys")).alias("source_hash"), "excerpts")
    return rows.mapInArrow(run, "scope string, bucket string, summary string, child_count int, source_hash string")


def _gathered(rows: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("key", "summary")))
    return rows.groupBy("scope", "bucket").agg(ordered.alias("rows")).select("scope", "bucket", F.transform("rows", lambda r: r["summary"]).alias("texts"), F.transform("rows", lambda r: r["key"]).alias("keys"))


def roll_up(sessions: DataFrame, strategy: str, engine: Engine, *, excerpts: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Roll-ups of every scope and bucket, from (session_id, content_hash, scope, bucket, summary) rows.

    Scopes are merged deepest first, one job a level: a scope's children are the roll-ups right below it and the
    sessions right at it; the flat strategy takes all sessions below instead. A roll-up in ``known`` (scope,
    bucket, summary, child_count, source_hash) with the same children is taken over without the engine.
    """
    how = merger(strategy)
    own = sessions.select("scope", "bucket", F.concat_ws(":", "session_id", "content_hash").alias("key"), "summary")
    none = F.array().cast("array<string>")

    def made(children: DataFrame) -> DataFrame:
        rows = children.withColumn("excerpts", none)
        if how.with_excerpts and excerpts is not None:
            given = excerpts.groupBy("scope", "bucket").agg(F.collect_list("text").alias("given"))
            rows = children.join(given, ["scope", "bucket"], "left").withColumn("excerpts", F.coalesce("given", none)).drop("given")
        if known is None:
            return merged(rows, engine)
        same = rows.withColumn("source_hash", content_hash(F.col("keys"))).join(known.select("scope", "bucket", "source_hash"), ["scope", "bucket", "source_hash"], "left_anti")
        fresh = merged(same.select(*rows.columns), engine)
        kept = known.join(rows.select("scope", "bucket", content_hash(F.col("keys")).alias("source_hash")), ["scope", "bucket", "source_hash"], "left_semi")
        return fresh.unionByName(kept.select(*fresh.columns))

    if how.from_sessions:
        return made(_gathered(own.withColumn("scope", F.explode(ancestors(F.col("scope"))))))
    deepest = own.agg(F.max(scope_depth(F.col("scope")))).first()[0]
    if deepest is None:
        return made(_gathered(own))
    done = None
    below = None
    for depth in range(deepest, -1, -1):
        here = own.where(scope_depth(F.col("scope")) == depth)
        if below is not None:
            here = here.unionByName(below.select(parent_scope(F.col("scope")).alias("scope"), "bucket", F.concat_ws(":", "scope", "source_hash").alias("key"), "summary"))
        below = made(_gathered(here)).persist()
        done = below if done is None else done.unionByName(below)
    return done


def split_texts(parts: list[str]) -> list[list[str]]:
    """The two halves of several texts, or of one text at the line end, else the space, nearest its middle; nothing for a text too short to split."""
    if len(parts) > 1:
        return [parts[: len(parts) // 2], parts[len(parts) // 2 :]]
    text = parts[0].strip() if parts else ""
    if len(text) < LEAST_SPLIT:
        return []
    middle = len(text) // 2
    places = [at for mark in ("\n", " ") for at in sorted((p for p in (text.find(mark, middle), text.rfind(mark, 0, middle)) if p > 0), key=lambda p: abs(p - middle))]
    cut = places[0] if places else middle
    return [[text[:cut].rstrip()], [text[cut:].lstrip()]]


def extract_claims(texts: DataFrame, engine: Engine, *, most_chars: int = 24_000) -> DataFrame:
    """(session_id, lens, claim_index, claim, reason, raw_excerpt): claims of each session's texts, failures as rows with a reason.

    Texts beyond the engine's room, and those whose reply can't be read, are split in halves until it works, and the parts' claims
    united in order; a text of under ``LEAST_SPLIT`` characters is not split, its failure is the session's.
    """

    def claims_of(parts: list[str]) -> dict[str, list[str]]:
        made: dict[str, list[str]] = {}
        left = [parts]
        while left:
            here = left.pop()
            whole, halves = "\n\n".join(here), split_texts(here)
            if halves and len(whole) > most_chars:
                left += reversed(halves)
                continue
            try:
                found = claim_lists(engine(whole))
            except (ValueError, KeyError):
                if not halves:
                    raise
                left += reversed(halves)
                continue
            made = {k: list(dict.fromkeys(made.get(k, []) + c)) for k, c in found.items()}
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for session, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = claims_of(parts or [])
                    rows += [(session, lens, n, c, None, None) for lens, made in found.items() for n, c in enumerate(made)]
                except (ValueError, KeyError) as error:
                    rows.append((session, None, None, None, str(error), json.dumps(parts)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["session_id", "lens", "claim_index", "claim", "reason", "raw_excerpt"])

    return texts.select("session_id", "texts").mapInArrow(run, "session_id string, lens string, claim_index int, claim string, reason string, raw_excerpt string")
