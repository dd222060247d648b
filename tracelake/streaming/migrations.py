"""One-shot rewrites of kept tables, gated by a sentinel: here the pruning of events that were read from several copies of a file.

A lake is a folder of generations: ``base`` with the tables as they were written, and one for each migration with the tables that it
rewrites. A migration writes all its tables, then its sentinel: one small file with the rows that each table had and lost. Without it
none of them counts, so a migration that was cut off anywhere is just done again, readers see the old tables until the sentinel is
there and the new ones from then on, and a second call does nothing. ``base`` stays, so it can be looked at or dropped later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import usage
from tracelake.sources.scratch import settled

BASE = "base"
_SENTINEL = "nth int, position int, table string, rows_before long, rows_deleted long, name string"

#: The tables of a lake to those that are rewritten, by name.
Plan = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def sentinels(spark: SparkSession, root: str) -> DataFrame:
    """(nth, position, table, rows_before, rows_deleted, name) of all migrations that are complete; a few rows each."""
    try:
        return spark.read.schema(_SENTINEL).parquet(f"{root}/migrations")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SENTINEL)


def save(tables: dict[str, DataFrame], root: str, generation: str = BASE) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{generation}/{name}")


def present(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table as the last complete migration that rewrote it left it."""
    last = sentinels(spark, root).where(F.col("table") == table).orderBy(F.desc("nth")).select("name").first()
    return spark.read.parquet(f"{root}/{last.name if last else BASE}/{table}")


def migrate(spark: SparkSession, root: str, name: str, tables: list[str], plan: Plan) -> DataFrame | None:
    """Rewrite tables once: (table, rows_before, rows_deleted) in the order of the plan, or None if the migration was complete before."""
    if name in (BASE, "migrations"):
        raise ValueError(f"a migration can't be called {name!r}")
    done = {r.name for r in sentinels(spark, root).select("name").distinct().collect()}
    if name in done:
        return None
    old = {t: present(spark, root, t) for t in tables}
    made = plan(old)
    save(made, root, name)
    rows = []
    for position, t in enumerate(made):
        # row counts come from the files' footers
        before = old[t].count() if t in old else 0
        rows.append((len(done), position, t, before, before - spark.read.parquet(f"{root}/{name}/{t}").count()))
    fields = _SENTINEL.rpartition(", ")[0]
    spark.createDataFrame(rows, fields).coalesce(1).write.mode("overwrite").parquet(f"{root}/migrations/name={name}")
    return sentinels(spark, root).where(F.col("name") == name).orderBy("position").select("table", "rows_before", "rows_deleted")


def repeated_events(events: DataFrame) -> DataFrame:
    """(event_key): the events beside the first, by key, of each session and uuid; a null session is one of its own, events without a uuid are all different."""
    named = events.where(F.col("event_uuid").isNotNull())
    # counted before they are shuffled, so one session with most of the events is no hot group
    first = named.groupBy("session_id", "event_uuid").agg(F.min("event_key").alias("event_key"))
    return named.select("event_key").join(first, "event_key", "left_anti").distinct()


def without_repeats(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The plan that prunes repeated events and all that hangs on them.

    From ``events`` (event_key, session_id, event_uuid, source_file and what the roll-ups read), ``edges`` (edge_key, project_id, session_id,
    event_uuid, parent_uuid, source_file), ``files`` (source_file), and any of ``calls`` (event_key), ``chunks`` (chunk_key, event_key), ``entities``
    and ``chunk_logs`` (chunk_key). Of an edge, nulls being equal, the least key stays; files stay that an event or an edge is left of;
    ``entities`` and ``chunk_logs`` stay for chunks that are left. ``cube`` and ``sessions`` are made anew from the events that are left.
    """
    gone = settled(repeated_events(tables["events"]), "repeats")
    made = {t: tables[t].join(gone, "event_key", "left_anti").select(*tables[t].columns) for t in ("events", "calls", "chunks") if t in tables}
    edges = tables["edges"]
    least = edges.groupBy("project_id", "session_id", "event_uuid", "parent_uuid").agg(F.min("edge_key").alias("edge_key"))
    made["edges"] = edges.join(least.select("edge_key"), "edge_key", "left_semi").select(*edges.columns)
    used = made["events"].select("source_file").unionByName(made["edges"].select("source_file")).distinct()
    made["files"] = tables["files"].join(used, "source_file", "left_semi").select(*tables["files"].columns)
    if "chunks" in tables:
        left = made["chunks"].select("chunk_key").distinct()
        made |= {t: tables[t].join(left, "chunk_key", "left_semi").select(*tables[t].columns) for t in ("entities", "chunk_logs") if t in tables}
    return made | {"cube": usage.cube(made["events"]), "sessions": usage.sessions(made["events"])}


def drop_repeats(spark: SparkSession, root: str, tables: list[str]) -> DataFrame | None:
    """The migration ``without-repeats`` of a lake."""
    return migrate(spark, root, "without-repeats", tables, without_repeats)
