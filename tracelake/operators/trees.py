"""Parent links between events: descendants, however deep, in few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.sources.scratch import settled


def descendants(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) of all nodes below the roots in (parent, child) links, by their shortest ways; cycles end.

    Jumps over 1, 2, 4, ... links: a round joins what is reached with the jumps of its length and those with themselves, so a chain of n
    links takes log n rounds. A round that reaches nothing new is the last, as each node's shortest way passes all depths before its own.
    """
    seen = settled(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct(), "descendants")
    jumps = settled(links.where("parent <> child").select("parent", "child").distinct(), "jumps")
    length = 1
    while True:
        step = seen.join(jumps.withColumnRenamed("parent", "node"), "node").groupBy("root", F.col("child").alias("node")).agg((F.min("depth") + length).alias("depth"))
        fresh = settled(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"), "descendants")
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
        above, below = jumps.withColumnRenamed("child", "via"), jumps.withColumnRenamed("parent", "via")
        jumps = settled(above.join(below, "via").select("parent", "child").distinct(), "jumps")
        length *= 2


def tree_below(spark, links_view: str, root: int) -> DataFrame:
    """(node, depth) of the same for one root of a link view."""
    roots = spark.range(1).select(F.lit(int(root)).cast("long").alias("node"))
    return descendants(spark.table(links_view), roots).select("node", "depth")
