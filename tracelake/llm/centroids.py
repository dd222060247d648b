"""Centroid clustering in whole numbers: float32 screening with rounding-error intervals, exact numbers where they overlap.

``nearest`` finds each point's nearest centre. One float32 matrix product gives ``|c|^2 - 2 v.c`` for all centres of a block of
points. A sum of n products in float32 is off by at most ``g |a|.|b|`` with ``g = n u / (1 - n u)`` and ``u = 2^-24``, in whatever order
it is added up; with the rounding of the factors n is the components + 4. So every value lies within a known distance of the exact
one, and centres whose intervals don't reach the lowest one's are out. Where more than one is left, the squared distances of
these are worked out in whole numbers; of equal ones the lowest number wins. Numbers beyond what float32 products can hold are
screened in float64, and beyond 64-bit sums compared as Python integers.

Each round is one pass over the vectors, whose tasks give their sums for each centre; Spark adds them up, and the driver holds
``k`` centres, never rows. Sums go as two limbs, so that they are exact for any input.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out. Repeated rows count
each. Rows without an id are kept and, as centres to start from, come last. With fewer vectors than centres each is one. A squared
distance or a sum beyond 64 bits is given as the greatest long. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import freeing, table, written

#: What op12 asks for: components, factor, centres, rounds and the seed's label.
SIZE, SCALE, CENTRES, ROUNDS, SEED = 64, 256, 40, 5, "2"
#: Points that one matrix product takes.
BLOCK = 4096
LONG_MOST = (1 << 63) - 1
_LIMB = 40


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def whole(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of an Arrow column of vectors of one length, exactly; int64, or Python integers where that is too small. ``scale`` is a power of two."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = flat.reshape(len(column), -1) if len(column) and len(flat) else np.zeros((len(column), 0))
    if not flat.size or np.abs(flat).max() < 2.0**52 / scale:
        return np.floor(flat * scale).astype(np.int64)
    # from 2^52 on a double is a whole number itself
    exact = np.array([int(x) * scale if abs(x) >= 2.0**52 / scale else int(np.floor(x * scale)) for x in flat.ravel().tolist()], object)
    return exact.reshape(flat.shape)


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    if a.dtype == object or b.dtype == object or a.shape[1] * (_most(a) + _most(b)) ** 2 > LONG_MOST:
        return np.array([sum((int(p) - int(q)) ** 2 for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True)], object)
    return ((a - b) ** 2).sum(axis=1)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number and the exact squared distance of each point's nearest centre; of equal ones the lowest number."""
    n, size = points.shape
    near = np.zeros(n, np.int64)
    if not n:
        return near, np.zeros(0, np.int64)
    reach = size * (_most(points) + _most(centres)) ** 2
    kind, unit = (np.float32, 2.0**-24) if reach < 2**100 else (np.float64, 2.0**-53)
    error = (size + 4) * unit / (1 - (size + 4) * unit)
    fine = centres.astype(np.float64)
    norms = (fine**2).sum(axis=1)
    # the last row of the product's right side meets a component that is one
    right = np.vstack([-2 * fine.T, norms]).astype(kind)
    top = float(norms.max()) * (1 + 1e-9)
    for start in range(0, n, BLOCK):
        block = points[start : start + BLOCK]
        left = np.ones((len(block), size + 1), kind)
        left[:, :size] = block
        value = left @ right
        rows = np.arange(len(block))
        best = value.argmin(axis=1)
        least = value[rows, best].astype(np.float64)
        length = np.sqrt((block.astype(np.float64) ** 2).sum(axis=1))
        half = error * (2 * length * np.sqrt(top) + top) * (1 + 1e-9)
        bar = np.nextafter((least + 2 * half + 4 * unit * np.abs(least)).astype(kind), kind(np.inf))
        value[rows, best] = np.inf
        unsure = np.flatnonzero(~(value.min(axis=1) > bar)) if len(centres) > 1 else rows[:0]
        value[rows, best] = least.astype(kind)
        for k in range(0, len(unsure), 256):
            some = unsure[k : k + 256]
            row, centre = np.nonzero(~(value[some] > bar[some, None]))
            exact = squared(block[some[row]], centres[centre])
            # rows are ascending, and so are the centres of a row
            order = sorted(range(len(row)), key=lambda i: (row[i], exact[i], centre[i])) if exact.dtype == object else np.lexsort((centre, exact, row))
            order = np.asarray(order)
            first = order[np.unique(row[order], return_index=True)[1]]
            best[some] = centre[first]
        near[start : start + len(block)] = best
    return near, squared(points, centres[near])


def group_sums(points: np.ndarray, near: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, count, sums) of the centres that have points; exact."""
    order = np.argsort(near, kind="stable")
    centre, start = np.unique(near[order], return_index=True)
    counts = np.ones(len(near), np.int64) if weights is None else weights
    rows = points[order]
    if rows.dtype != object and _most(rows) * int(counts.sum()) > LONG_MOST:
        rows = rows.astype(object)
    rows = rows if weights is None else rows * counts[order][:, None]
    return centre, np.add.reduceat(counts[order], start), np.add.reduceat(rows, start, axis=0)


SUMS_SCHEMA = "centre int, count long, low array<long>, high array<decimal(38,0)>"
_SUMS = pa.schema([("centre", pa.int32()), ("count", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.decimal128(38, 0)))])


class Sums:
    """A task's running sums for each centre, given out as limbs: sum = high * 2^40 + low."""

    def __init__(self):
        self.held: dict[int, tuple[int, np.ndarray]] = {}

    def add(self, points: np.ndarray, near: np.ndarray, weights: np.ndarray | None = None, offset: int = 0) -> None:
        if len(points):
            for c, n, total in zip(*group_sums(points, near, weights), strict=True):
                old = self.held.get(offset + int(c))
                total = total.astype(object)
                self.held[offset + int(c)] = (int(n) + (old[0] if old else 0), total + old[1] if old else total)

    def batches(self) -> Iterator[pa.RecordBatch]:
        import decimal

        if self.held:
            mask = (1 << _LIMB) - 1
            rows = [{"centre": c, "count": n, "low": [int(x) & mask for x in total], "high": [decimal.Decimal(int(x) >> _LIMB) for x in total]} for c, (n, total) in self.held.items()]
            yield pa.RecordBatch.from_pylist(rows, _SUMS)


def added_up(partial: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Count and sums of each centre, from the tasks' rows; as many numbers as the centres have components."""
    parts = partial.select("centre", "count", F.posexplode(F.arrays_zip("low", "high")).alias("at", "limb"))
    rows = parts.groupBy("centre", "at").agg(F.sum("count").alias("n"), F.sum("limb.low").alias("low"), F.sum("limb.high").alias("high")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r.centre, r["at"])):
        found.setdefault(r.centre, (r.n, []))[1].append((int(r.high) << _LIMB) + r.low)
    return found


def moved(centres: list[list[int]], sums: dict[int, tuple[int, list[int]]]) -> list[list[int]]:
    """Each centre that has points at the floor of their mean; the others as they were."""
    return [[x // sums[j][0] for x in sums[j][1]] if j in sums else c for j, c in enumerate(centres)]


def as_matrix(centres: list[list[int]]) -> np.ndarray:
    fits = all(abs(x) < 1 << 62 for c in centres for x in c)
    return np.array(centres, np.int64 if fits else object).reshape(len(centres), len(centres[0]) if centres else 0)


def digest(centre: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def kept_vectors(vectors: DataFrame, *, size: int = SIZE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col(vector_col)
    return vectors.where((F.size(v) == size) & finite(v)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def starting_centres(kept: DataFrame, *, scale: int = SCALE, centres: int = CENTRES, seed: str = SEED) -> list[list[int]]:
    """The vectors whose seeded ids have the smallest hashes, by hash, then by content; ``centres`` rows reach the driver."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(hashed.alias("hash"), "vector").orderBy(F.asc_nulls_last("hash"), "vector").limit(centres).select("vector").toArrow()
    return [[int(x) for x in row] for row in whole(first.column(0), scale)]


def cluster(vectors: DataFrame, *, size: int = SIZE, scale: int = SCALE, centres: int = CENTRES, rounds: int = ROUNDS, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, written, and the final centres."""
    kept = kept_vectors(vectors, size=size, id_col=id_col, vector_col=vector_col)
    at = starting_centres(kept, scale=scale, centres=centres, seed=seed)
    for _ in range(rounds if at else 0):
        at = moved(at, added_up(kept.select("vector").mapInArrow(freeing(_summing(as_matrix(at), scale)), SUMS_SCHEMA)))
    return written(kept.mapInArrow(freeing(_assigning(as_matrix(at), scale)), "vec_id long, cluster int, distance long"), "clusters"), at


def _summing(centres: np.ndarray, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            points = whole(batch.column(0), scale)
            sums.add(points, nearest(points, centres)[0])
        yield from sums.batches()

    return run


def _assigning(centres: np.ndarray, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, distance = nearest(whole(batch.column(1), scale), centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array([min(int(d), LONG_MOST) for d in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def as_long(total: Column) -> Column:
    """A sum of longs kept as decimal, as a long."""
    return F.least(total, F.lit(LONG_MOST).cast("decimal(38,0)")).cast("long")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centres = cluster(table(spark, sf_dir, "embeddings"))
    # one row a cluster
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = min(sum(int(r.s) for r in sums), LONG_MOST)
    facts = spark.createDataFrame([(r.cluster, min(int(r.s), LONG_MOST), total, digest(centres[r.cluster])) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
