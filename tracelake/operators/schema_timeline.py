"""Which key paths JSON records have, day by day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.sources.scratch import settled


def key_paths(records: DataFrame, raw: str = "raw") -> DataFrame:
    """(…, path) of the object keys of a variant column, however deep, once for each record; array elements share their array's path with ``[]``."""
    rest = [c for c in records.columns if c != raw]
    # the numbers of the records are written with them, so that they hold for every level
    numbered = settled(records.withColumn("__record", F.monotonically_increasing_id()), "records")
    kept = [*rest, "__record"]
    level = numbered.select(*kept, F.lit("$").alias("path"), F.col(raw).alias("node"))
    found = None
    while True:
        view = f"level_{uuid.uuid4().hex}"
        level.createOrReplaceTempView(view)
        step = level.sparkSession.sql(f"SELECT {', '.join(f't.`{c}`' for c in kept)}, t.path AS above, e.key AS key, e.value AS node FROM {view} t, LATERAL variant_explode(t.node) AS e")
        level = settled(step.select(*kept, F.when(F.col("key").isNull(), F.concat("above", F.lit("[]"))).otherwise(F.concat_ws(".", "above", "key")).alias("path"), "node"), "paths")
        level.sparkSession.catalog.dropTempView(view)
        keys = level.select(*kept, "path")
        found = keys if found is None else found.unionByName(keys)
        if level.isEmpty():
            return found.distinct().select(*rest, "path")


def schema_timeline(paths: DataFrame) -> DataFrame:
    """(json_path, event_date, n_events, first_seen) from (path, date) rows."""
    per = paths.groupBy(F.col("path").alias("json_path"), F.col("date").alias("event_date")).agg(F.count(F.lit(1)).alias("n_events"))
    return per.withColumn("first_seen", F.min("event_date").over(W.partitionBy("json_path")))


def path_stats(timeline: DataFrame) -> DataFrame:
    """Days and events of each path."""
    return timeline.groupBy("json_path").agg(F.count(F.lit(1)).alias("n_days"), F.sum("n_events").alias("n_events"))
