"""Descendants at any depth."""

from __future__ import annotations

from tracelake.operators import trees


def test_deep_chain_and_cycle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(23)] + [(23, 3)], "parent long, child long").coalesce(1).cache()
    links.createOrReplaceTempView("chain_links")
    assert sorted(map(tuple, trees.tree_below(spark, "chain_links", 0).collect())) == [(i, i) for i in range(24)]


def test_long_chain_in_few_rounds(spark):
    n = 5000
    links = spark.range(n).selectExpr("id AS parent", "id + 1 AS child").unionByName(spark.createDataFrame([(n, n - 3), (7, 9)], "parent long, child long"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {r.node: r.depth for r in trees.descendants(links, spark.createDataFrame([(0,), (0,)], "node long")).collect()}
    assert got == {k: k - (k > 8) for k in range(n + 1)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 400
