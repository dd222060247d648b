"""Nearest neighbours of all vectors under cosine distance: exactly by cells where few of them can hold what is near, else by random hyperplanes and an exact check.

Cells are those of pivots, rows that their keys' hashes pick: a vector lies in the cell of the pivot at the least angle. It first meets its own
cell, which bounds how far its ``k`` nearest can be; the angle to the plane that halves the way to another pivot then tells whether that
pivot's cell can hold any of them, and only to such cells it goes, as a query. Cells beyond four tiles are cut into rooms, queries of a room
into parts, so no task gets a large cell whole. If vectors would go to more cells than there are tables (those of many independent components do),
they go by tables.

Each of several tables gives a vector a code: on which sides of its hyperplanes it lies. Two vectors at an angle t agree in one bit with
probability 1 - t / pi, so the number of tables follows from the bits and from the probability ``miss`` with which a pair at the
greatest distance that counts may share no bucket; nearer pairs are missed less. Vectors of a bucket meet in blocks: a bucket
beyond ``tile`` rows is cut into tiles, each pair of which is a block of its own, so no task gets a large bucket whole and no
pair becomes a row unless it is among the ``k`` nearest of one of its ends there, and then in the first table in which it meets.

Equal vectors meet the others once, as a class under their least key. A class counts by its least key and tells its ``k + 1`` least ones:
whatever stands behind them is behind ``k`` others for every key.

Defined cases: null vectors, vectors with null or non-finite components and those of length 0 have no neighbours. Repeated keys count
once, by their least vector. All vectors must have the same length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.sources.scratch import settled

#: Vectors that share a bucket on average, rows of a tile, and large buckets whose list is broadcast at most.
BUCKET_ROWS, TILE, FEW_BUCKETS = 256, 1024, 200_000
#: Pivots at most, and what a distance of six places may differ from the one that it rounds, or a bound from its exact value.
PIVOTS, SLACK = 8192, 6e-7


def table_count(bits: int, most: float, miss: float) -> int:
    """Tables after which a pair at distance ``most`` shares no bucket with probability ``miss``."""
    agree = (1 - math.acos(1 - most) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column as rows of length 1."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    points = flat.flatten().to_numpy().reshape(len(flat), -1)
    return points / np.sqrt((points**2).sum(axis=1))[:, None]


def _best(cosines: np.ndarray, within: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of each row's ``k`` least distances that are within its bound, ties to the lesser column."""
    rows, columns = np.nonzero(cosines >= 1 - within[:, None] - SLACK)
    far = np.round(1 - cosines[rows, columns], 6) + 0.0
    near = far <= within[rows]
    rows, columns, far = rows[near], columns[near], far[near]
    order = np.lexsort((columns, far, rows))
    rows, columns, far = rows[order], columns[order], far[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], columns[first], far[first]


def _by_cells(base: DataFrame, n: int, k: int, most: float, tile: int, tables: int) -> DataFrame | None:
    """(a, b, distance): the ``k`` nearest others of every key of ``base`` (id, v), exactly; None where vectors would go to more than ``tables`` cells on average."""
    spark, kind = base.sparkSession, base.schema["id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    picked = base.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-n // tile))).select("v").collect()
    pivots = _unit(pa.array([r.v for r in picked], pa.list_(pa.float64())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([pa.array((_unit(part.column(1)) @ pivots.T).argmax(axis=1), pa.int32()), *part.columns], ["cell", "id", "v"])

    placed = settled(base.mapInArrow(place, f"cell int, id {kind}, v array<double>"), "cells")
    sizes = np.zeros(len(pivots), np.int64)
    for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[row.cell] = row.n
    rooms = np.maximum(1, -(-sizes // (4 * tile)))
    first = np.cumsum(rooms) - rooms
    table = spark.createDataFrame([(c, int(f), int(r)) for c, (f, r) in enumerate(zip(first, rooms, strict=True))], "cell int, first int, rooms int")
    housed = placed.join(F.broadcast(table), "cell").withColumn("room", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("rooms"))).cast("int")).select("room", "cell", "id", "v")

    def lists(rows: np.ndarray, values: pa.Array, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, cell, room, unit = group.column("id").combine_chunks(), group.column("cell")[0].as_py(), group.column("room")[0].as_py(), _unit(group.column("v"))
        gaps, out = np.sqrt(((pivots - pivots[cell]) ** 2).sum(axis=1)), []
        for low in range(0, len(unit), 256):
            part = unit[low : low + 256]
            here = np.arange(len(part))
            cosines = part @ unit.T
            cosines[here, low + here] = -2.0
            within = np.full(len(part), most)
            if k < len(unit):
                within = np.minimum(within, np.round(1 - np.partition(cosines, -k, axis=1)[:, -k], 6) + 0.0)
            rows, columns, far = _best(cosines, within, k)
            # the sine of the angle between a vector and the plane halfway to a pivot, beyond which that pivot's cell lies
            to = part @ pivots.T
            reach = np.sin(np.minimum(np.arccos(np.maximum(1 - within - SLACK, -1.0)), np.pi / 2)) + 1e-9
            # parallel pivots share what lies around them by the last bits
            may = (to[:, [cell]] - to <= reach[:, None] * gaps + 1e-12) | (within[:, None] >= 1)
            may[:, cell] = True
            of, cells = np.nonzero(may)
            each = rooms[cells]
            goes = np.repeat(first[cells] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            of = np.repeat(of, each)
            of, goes = of[goes != room], goes[goes != room]
            columns = [ids.slice(low, len(part)), group.column("v").combine_chunks().slice(low, len(part)), pa.array(within), lists(rows, ids.take(pa.array(columns)), len(part)), lists(rows, pa.array(far), len(part)), lists(of, pa.array(goes, pa.int32()), len(part)), pa.array(may.sum(axis=1) - 1, pa.int32())]
            out.append(pa.table(columns, ["a", "v", "within", "b", "distance", "rooms", "cells"]))
        return pa.concat_tables(out)

    met = settled(housed.groupBy("room").applyInArrow(meet, f"a {kind}, v array<double>, within double, b array<{kind}>, distance array<double>, rooms array<int>, cells int"), "met")
    own = met.select("a", F.explode(F.arrays_zip("b", "distance")).alias("one")).select("a", "one.b", "one.distance")
    if (met.agg(F.sum("cells")).first()[0] or 0) > n * tables:
        return None
    asked = met.select(F.explode("rooms").alias("room"), "a", "v", "within")
    parts = settled(asked.groupBy("room").agg(F.ceil(F.count(F.lit(1)) / (16 * tile)).cast("int").alias("parts")), "rooms")
    queries = asked.join(F.broadcast(parts), "room").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    members = housed.join(F.broadcast(parts), "room").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def answer(members: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(pa.array([], arrow), pa.array([], arrow), pa.array([], pa.float64()))]
        if len(members) and len(queries):
            members = members.sort_by("id")
            ids, unit, asking, points = members.column("id").combine_chunks(), _unit(members.column("v")), queries.column("a").combine_chunks(), _unit(queries.column("v"))
            within = queries.column("within").to_numpy()
            for low in range(0, len(points), 256):
                rows, columns, far = _best(points[low : low + 256] @ unit.T, within[low : low + 256], k)
                found.append((asking.take(pa.array(low + rows)), ids.take(pa.array(columns)), pa.array(far)))
        return pa.table([pa.chunked_array(c) for c in zip(*found, strict=True)], ["a", "b", "distance"])

    others = members.select("room", "part", "id", "v").groupBy("room", "part").cogroup(queries.groupBy("room", "part")).applyInArrow(answer, f"a {kind}, b {kind}, distance double")
    return own.unionByName(others)


def _by_tables(base: DataFrame, size: int, bits: int, tables: int, k: int, most: float, tile: int, seed: int) -> DataFrame:
    """(a, b, distance): what is among the ``k`` nearest of a key of ``base`` (id, v) in some bucket of the tables of hyperplanes."""
    kind = base.schema["id"].dataType.simpleString()
    planes = np.random.default_rng(seed).normal(size=(tables, bits, size)).astype(np.float32)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def code(batches: Iterator[pa.RecordBatch], with_vectors: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([np.asarray(x, np.float64) for x in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros((0, size))
            for t in range(tables):
                codes = pa.array(((points @ planes[t].T) > 0) @ powers, pa.int64())
                cols = [pa.array(np.full(len(points), t, np.int32)), codes]
                yield pa.RecordBatch.from_arrays([*cols, batch.column(0), batch.column(1)] if with_vectors else cols, ["tab", "code", "id", "v"] if with_vectors else ["tab", "code"])

    sizes = base.mapInArrow(lambda b: code(b, False), "tab int, code long").groupBy("tab", "code").agg(F.count(F.lit(1)).alias("n"))
    large = settled(sizes.where(F.col("n") > tile).select("tab", "code", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "buckets")
    coded = base.mapInArrow(lambda b: code(b, True), f"tab int, code long, id {kind}, v array<double>")
    few = large.count() <= FEW_BUCKETS
    dealt = coded.join(F.broadcast(large) if few else large, ["tab", "code"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    arrow = pa.string() if kind == "string" else pa.int64()

    def block(group: pa.Table) -> pa.Table:
        ids, points = group.column("id").to_pylist(), np.stack([np.asarray(x) for x in group.column("v").to_pylist()])
        unit = points / np.sqrt((points**2).sum(axis=1))[:, None]
        side = np.array(group.column("own").to_pylist())
        within = group.column("low")[0] == group.column("high")[0]
        # a pair is told by the first table in which it meets: what is not among the best of that bucket is among no key's best
        before = np.stack([((points @ planes[t].T) > 0) @ powers for t in range(group.column("tab")[0].as_py())] or [np.full(len(ids), -1)], axis=1)
        out: tuple[list, list, list] = ([], [], [])
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
        for start in range(0, len(ids), 256):
            rows = order[start : start + 256]
            far, pairs = np.round(1 - unit[rows] @ unit[order].T, 6) + 0.0, []
            for i, line in zip(rows, far, strict=True):
                near = np.flatnonzero(line <= most)
                near = near[(order[near] != i) & (within or side[order[near]] != side[i])]
                best = near[np.argsort(line[near], kind="stable")[:k]]
                pairs.extend((i, j, d) for j, d in zip(order[best].tolist(), line[best].tolist(), strict=True))
            ends = np.array([p[:2] for p in pairs], np.int64).reshape(-1, 2)
            fresh = ~((before[ends[:, 0]] == before[ends[:, 1]]) & (before[ends[:, 0]] >= 0)).any(axis=1)
            for (i, j, d), new in zip(pairs, fresh.tolist(), strict=True):
                if new:
                    out[0].append(ids[i])
                    out[1].append(ids[j])
                    out[2].append(d)
        return pa.table([pa.array(out[0], arrow), pa.array(out[1], arrow), pa.array(out[2], pa.float64())], ["a", "b", "distance"])

    wide = "string" if kind == "string" else "long"
    return met.select("tab", "code", "low", "high", "own", F.col("id").cast(wide).alias("id"), "v").groupBy("tab", "code", "low", "high").applyInArrow(block, f"a {wide}, b {wide}, distance double").distinct()


def vector_neighbours(vectors: DataFrame, key: str, vector: str, *, k: int = 10, most: float = 0.15, miss: float = 0.01, bucket_rows: int = BUCKET_ROWS, tile: int = TILE, seed: int = 7) -> DataFrame:
    """(a, b, distance, rank): the ``k`` nearest others of every key within the cosine distance ``most``, ties to the lesser key."""
    v = F.col(vector)
    usable = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    keyed = settled(vectors.where(usable & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(v.cast("array<double>")).alias("v")), "neighbours")
    kind = keyed.schema["id"].dataType.simpleString()
    # a class for all equal vectors, under its least key; no member has a neighbour in it beyond its k + 1 least keys
    least = keyed
    for by in (["v", F.pmod(F.xxhash64("id"), F.lit(64))], ["v"]):
        least = least.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("place") <= k + 1)
    classes = settled(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("id"), "v", "ids"), "classes")
    base = classes.select("id", "v")
    n, size = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    bits = max(2, math.ceil(math.log2(max(n, 1) / bucket_rows)))
    tables = table_count(bits, most, miss)
    wide = "string" if kind == "string" else "long"
    found = _by_cells(base.select(F.col("id").cast(wide).alias("id"), "v"), n, k, most, tile, tables) if n else None
    if found is None:
        found = _by_tables(base, size, bits, tables, k, most, tile, seed)
    rank = F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))
    near = found.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "distance")
    # every class's best keys, its own ones among them
    keys = classes.select(F.col("id").cast(wide).alias("b"), F.transform("ids", lambda x: x.cast(wide)).alias("ids"))
    own_keys = keys.select(F.col("b").alias("a"), "b", F.lit(0.0).alias("distance"))
    told = near.unionByName(own_keys).join(keys, "b").select("a", "distance", F.explode("ids").alias("b"))
    best = told.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("distance", "b"))).alias("best"))
    lists = settled(best.join(classes.select(F.col("id").cast(wide).alias("a"), "v"), "a").select("v", "best"), "nearest")
    each = keyed.select(F.col("id").cast(wide).alias("a"), "v").join(lists, "v")
    # a member is not its own neighbour
    others = each.select("a", F.posexplode(F.slice(F.filter("best", lambda x: x["b"] != F.col("a")), 1, k)).alias("at", "one"))
    return others.select("a", F.col("one.b").alias("b"), F.col("one.distance").alias("distance"), (F.col("at") + 1).alias("rank"))
