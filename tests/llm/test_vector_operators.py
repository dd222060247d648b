"""Clusters and codes of vectors against plain Python with whole numbers, and against their SQL."""

from __future__ import annotations

import hashlib
import math
import os
from fractions import Fraction

import numpy as np
import pytest

from tracelake.llm import centroids, vectorcodes
from tracelake.llm.queries import oracle_sql, queries

DATA = os.environ.get("TRACELAKE_TEST_DATA", "/root/testdata/sf0.001")
BIG = float(np.float32(3.0e38))


def floors(vector, scale):
    return [math.floor(Fraction(x) * scale) for x in vector]


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def closest(point, centres):
    return min((sum((a - b) ** 2 for a, b in zip(point, c, strict=True)), j) for j, c in enumerate(centres))


def lloyd(points, weights, centres, rounds):
    for _ in range(rounds):
        near = [closest(p, centres)[1] for p in points]
        for j in set(near):
            mine = [k for k, n in enumerate(near) if n == j]
            total = sum(weights[k] for k in mine)
            centres = [*centres[:j], [sum(points[k][i] * weights[k] for k in mine) // total for i in range(len(points[0]))], *centres[j + 1 :]]
    return centres, [closest(p, centres) for p in points]


def vector_rows(size, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=size).astype(np.float32)], int(i % 3) if i % 5 else None) for i in range(70)]
    rows += [(100 + i, rows[3][1], 1) for i in range(40)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0] * (size - 1) + [float("nan")], 1), (203, [1.0] * (size - 1) + [None], 1), (204, [float("inf")] * size, 0)]
    rows += [rows[5], rows[5], (None, rows[7][1], 2), (None, rows[8][1], None), (300, [0.0] * size, 1), (301, [float(np.float32(-1e-30))] * size, 1)]
    return rows


def as_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, b"y") for r in rows], "vec_id long, embedding array<float>, label int, cluster string, row int, part binary")


@pytest.mark.parametrize("size,big", [(64, False), (2, False), (3, True)])
def test_clusters(spark, size, big):
    rows = vector_rows(size) + [(400, [0.5] * (size + 1), 1)] + ([(500, [BIG] * size, 1), (501, [-BIG] + [1.5e9] * (size - 1), 2)] if big else [])
    got, centres = centroids.cluster(as_table(spark, rows), size=size, centres=9, rounds=4)
    kept = [(r[0], floors(r[1], 256)) for r in rows if usable(r[1]) and len(r[1]) == size]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    want, near = lloyd([p for _, p in kept], [1] * len(kept), [p for _, p in order[:9]], 4)
    assert centres == want
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, j, min(d, centroids.LONG_MOST)) for (i, _), (d, j) in zip(kept, near, strict=True)), key=key)


@pytest.mark.parametrize("size,big", [(64, False), (8, False), (6, True)])
def test_codes(spark, size, big):
    rows = vector_rows(size) + [(400, [0.5] * (size + 1), 1)] + ([(500, [BIG] * size, 1), (501, [-BIG] + [40.0] * (size - 1), 2)] if big else [])
    got, books = vectorcodes.compress(as_table(spark, rows), entries=12, rounds=3)
    kept = [(r[0], floors(r[1], 1024), r[2]) for r in rows if usable(r[1])]
    part = -(-max(len(v) for _, v, _ in kept) // 4)
    kept = [(i, v + [0] * (4 * part - len(v)), label) for i, v, label in kept]
    packed = lambda v: [vectorcodes.packed(np.array(v[k * part : (k + 1) * part], object)) for k in range(4)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, packed(r[1])))
    codes, errors = [[] for _ in kept], [0] * len(kept)
    for k in range(4):
        parts = [v[k * part : (k + 1) * part] for _, v, _ in kept]
        want, near = lloyd(parts, [1] * len(kept), [v[k * part : (k + 1) * part] for _, v, _ in order[:12]], 3)
        assert books[k] == want
        for n, (d, j) in enumerate(near):
            codes[n].append(j)
            errors[n] += min(d, centroids.LONG_MOST)
    key = lambda r: (r[0] is None, *map(str, r))
    want_rows = [(i, label, c, min(e, centroids.LONG_MOST)) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)]
    assert sorted(((r.vec_id, r.label, r.codes, r.error) for r in got.collect()), key=key) == sorted(want_rows, key=key)


def test_ties_and_close_distances_go_to_the_exact_nearest():
    rng = np.random.default_rng(4)
    centres = rng.integers(-40_000, 40_000, (50, 16))
    centres[[7, 31]] = centres[3]
    centres[12] = centres[11] + np.eye(1, 16, dtype=np.int64)[0]
    points = np.vstack([centres, (centres[11] + centres[12]) // 2 + rng.integers(-1, 2, (300, 16)), rng.integers(-40_000, 40_000, (300, 16)), 0 * centres[:1]])
    for shift in (0, 1 << 21, 1 << 28, 1 << 45):
        near, distance = centroids.nearest(points + shift, centres + shift)
        for p, j, d in zip((points + shift).tolist(), near, distance, strict=True):
            assert closest(p, (centres + shift).tolist()) == (d, j)


def test_hot_keys_are_split(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "i int, k string")
    facts = rows.groupBy("k").count().withColumnRenamed("count", "weight").selectExpr("k", "weight", "length(k) AS n")
    for share in (0.5, 1 / 1024, 1.0):
        assert sorted((r.i, r.k, r.n) for r in vectorcodes.joined_by_weight(rows, facts, ["k"], 60, share).collect()) == sorted((r.i, r.k, len(r.k)) for r in rows.collect())


@pytest.mark.parametrize("name", ["op12_centroid_clusters", "op13_vector_codes"])
def test_queries_on_mixed_and_empty_tables(spark, tmp_path, name):
    for folder, rows in (("mixed", vector_rows(64)), ("empty", [])):
        as_table(spark, rows).write.parquet(f"{tmp_path}/{folder}/embeddings.parquet")
        got = queries()[name](spark, f"{tmp_path}/{folder}").collect()
        size = 64 if name.startswith("op12") else None
        want = [r[0] for r in rows if usable(r[1]) and len(r[1]) in (size or len(r[1]),)]
        assert sorted((r.vec_id for r in got), key=str) == sorted(want, key=str)
        if got and size is None:
            assert {r.label_error for r in got} and len({r.codebooks_sha256 for r in got}) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op12_centroid_clusters", "op13_vector_codes"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    found = con.execute(oracle_sql()[name])
    names = sorted(d[0] for d in found.description)
    want = [dict(zip([d[0] for d in found.description], r, strict=True)) for r in found.fetchall()]
    df = queries()[name](spark, DATA)
    assert sorted(df.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[c] for c in names) for r in want)
