"""Vector compression by parts: equal whole-number parts become weighted rows, weighted Lloyd rounds find each position's codebook.

Each vector is scaled, floored and cut into equal consecutive parts. Equal parts of a position are one row with their number as
weight, so that a round reads each different part once, however often it occurs. A round assigns every part to its nearest entry
(``centroids.nearest``: exact, ties to the lower index), adds the parts up by weight, and moves each used entry to the floor of
their mean. The driver and the tasks hold the codebooks, a number of entries that is a parameter. At last the codes and errors of
the different parts are joined back to the vectors. Parts that make up more than a fixed share of all rows, of which there can be
only so many, are joined by broadcast, so that no task gets all copies of one; the same holds for the sums by label.

Defined cases: vectors that are null or hold null or non-finite components are left out. Vectors of different lengths are filled
up with zeros at their ends to the greatest length, and that to a multiple of the number of parts. Repeated rows and ids count each,
ordered by id and content as entries to start from; rows without an id come last there. Fewer vectors than entries make fewer
entries. An error beyond 64 bits is given as the greatest long. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.centroids import LONG_MOST, SUMS_SCHEMA, Sums, added_up, as_long, as_matrix, finite, moved, nearest, whole
from tracelake.llm.common import freeing, table, written

#: What op13 asks for: factor, parts, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Keys with more than this share of all rows are joined by broadcast: no more than its inverse, for each position.
HOT_SHARE = 1 / 1024
#: Bytes that a component of a part may take, the smallest that its part fits in.
_WIDTHS = (2, 4, 8, 24)


def packed(part: np.ndarray) -> bytes:
    """The components of a part as little-endian signed numbers; equal parts, equal bytes."""
    most = max((abs(int(x)) for x in part), default=0)
    width = next(w for w in _WIDTHS if most < 1 << (8 * w - 1))
    return b"".join(int(x).to_bytes(width, "little", signed=True) for x in part)


def packed_rows(parts: np.ndarray) -> list[bytes]:
    if parts.dtype != object and (not parts.size or np.abs(parts).max() < 1 << 15):
        raw, size = parts.astype("<i2").tobytes(), 2 * parts.shape[1]
        return [raw[k * size : (k + 1) * size] for k in range(len(parts))]
    return [packed(p) for p in parts]


def unpacked(rows: list[bytes], size: int) -> np.ndarray:
    """The parts of ``size`` components each."""
    if not size or not rows:
        return np.zeros((len(rows), size), np.int64)
    if all(len(r) == 2 * size for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(len(rows), size).astype(np.int64)
    numbers = [[int.from_bytes(r[k : k + len(r) // size], "little", signed=True) for k in range(0, len(r), len(r) // size)] for r in rows]
    fits = all(abs(x) < 1 << 62 for n in numbers for x in n)
    return np.array(numbers, np.int64 if fits else object)


def cut_vectors(vectors: DataFrame, *, scale: int = SCALE, parts: int = PARTS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int, int]:
    """(row, vec_id, label, parts) of every kept vector, written; the components of a part, and the number of rows."""
    v = F.col(vector_col)
    kept = vectors.where(finite(v)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("vector"))
    longest = kept.agg(F.max(F.size("vector")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    size = -(-(longest.n or 0) // parts)
    zero = F.lit(0).cast(kept.schema["vector"].dataType.elementType)
    filled = F.concat("vector", F.array_repeat(zero, F.lit(size * parts) - F.size("vector")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = whole(batch.column(2), scale)
            rows = packed_rows(numbers.reshape(len(numbers) * parts, size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([rows[k : k + parts] for k in range(0, len(rows), parts)], pa.list_(pa.binary()))], ["vec_id", "label", "parts"])

    label = kept.schema["label"].dataType.simpleString()
    rows = kept.select("vec_id", "label", filled.alias("vector")).mapInArrow(freeing(cut), f"vec_id long, label {label}, parts array<binary>")
    # the row numbers are written with the rows, so that they hold for every later reading
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "cut-vectors"), size, longest.rows


def distinct_parts(cut: DataFrame) -> DataFrame:
    """(position, part, weight): each different part once, written."""
    return written(cut.select(F.posexplode("parts").alias("position", "part")).groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")


def learn_codebooks(cut: DataFrame, distinct: DataFrame, size: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """The codebook of each position after the rounds; ``entries`` rows reach the driver as a start."""
    first = cut.orderBy(F.asc_nulls_last("vec_id"), "parts").limit(entries).select("parts").collect()
    books = [[[int(x) for x in unpacked([bytes(r.parts[k])], size)[0]] for r in first] for k in range(parts)]
    for _ in range(rounds if first else 0):
        held = [as_matrix(b) for b in books]

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums = Sums()
            for batch in batches:
                for k, points, weight, _ in _by_position(batch, size):
                    sums.add(points, nearest(points, held[k])[0], weight, offset=k * entries)
            yield from sums.batches()

        sums = added_up(distinct.select("position", "part", "weight").mapInArrow(freeing(run), SUMS_SCHEMA))
        books = [moved(b, {c - k * entries: s for c, s in sums.items() if c // entries == k}) for k, b in enumerate(books)]
    return books


def _by_position(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    position = batch.column(0).to_numpy()
    for k in np.unique(position).tolist():
        at = np.flatnonzero(position == k)
        yield k, unpacked(batch.column(1).take(pa.array(at)).to_pylist(), size), batch.column(2).to_numpy()[at], at


def coded_parts(distinct: DataFrame, books: list[list[list[int]]], size: int) -> DataFrame:
    """(position, part, weight, code, error) of each different part, written."""
    held = [as_matrix(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for k, points, _, at in _by_position(batch, size):
                near, distance = nearest(points, held[k])
                code[at], error[at] = near, [min(int(d), LONG_MOST) for d in distance]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["position", "part", "weight", "code", "error"])

    return written(distinct.select("position", "part", "weight").mapInArrow(freeing(run), "position int, part binary, weight long, code int, error long"), "coded-parts")


def joined_by_weight(rows: DataFrame, facts: DataFrame, keys: list[str], n_rows: int, share: float = HOT_SHARE) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each of their keys and in ``weight`` how many rows have it.

    Keys of more than ``share`` of all rows, at most 1 / share, are broadcast; the others are joined by a shuffle in which none is large.
    """
    hot = facts.where(F.col("weight") > n_rows * share).drop("weight")
    rest = facts.where(F.col("weight") <= n_rows * share).drop("weight").hint("merge")
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def compress(vectors: DataFrame, *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, codes, error) of every kept vector, written, and the codebooks."""
    cut, size, n = cut_vectors(vectors, scale=scale, parts=parts, id_col=id_col, vector_col=vector_col, label_col=label_col)
    distinct = distinct_parts(cut)
    books = learn_codebooks(cut, distinct, size, parts=parts, entries=entries, rounds=rounds)
    coded = coded_parts(distinct, books, size)
    rows = cut.select("row", "vec_id", "label", F.posexplode("parts").alias("position", "part"))
    # of the rows of all positions, n * parts, a key has its weight
    found = joined_by_weight(rows, coded, ["position", "part"], n * parts).select("row", "vec_id", "label", "position", "code", "error")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda c: c["code"])
    whole_rows = found.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), codes.alias("codes"), as_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("error"))
    return written(whole_rows.drop("row"), "vector-codes"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    keyed = coded.select("vec_id", F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error", F.to_json(F.struct("label")).alias("label"))
    sums = keyed.groupBy("label").agg(as_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count(F.lit(1)).alias("weight"))
    n = coded.count()
    return joined_by_weight(keyed, sums, ["label"], n).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
