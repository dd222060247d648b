"""Helpers shared by the corpus operators: table access, scratch tables, Arrow text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass inside a task works on; a longer document is one pass of its own.
PASS_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of a session that names none.
_local: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset (tests, one machine), a local one. On a cluster it must be set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tracelake-"))
        where = _local[0]
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Parts of a sieve, of 32768 bits each: 1 MB in all, whatever the number of ids.
SIEVE_PARTS = 256


def sifted(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``maybe``: false for rows whose id is surely not among ``ids``. The ids are a bit map of fixed size, which alone goes to every task."""
    place = lambda c: F.pmod(F.shiftright(F.xxhash64(c), 8), F.lit(32768))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_PARTS))
    bits = ids.where(F.col(id_col).isNotNull()).groupBy(part(F.col(id_col)).alias("sieve_part")).agg(F.bitmap_construct_agg(place(F.col(id_col))).alias("sieve_bits"))
    at = place(F.col(id_col))
    octet = F.conv(F.hex(F.substring("sieve_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.bit_get(octet, (at % 8).cast("int")) == 1
    joined = rows.withColumn("sieve_part", part(F.col(id_col))).join(F.broadcast(bits), "sieve_part", "left")
    return joined.withColumn("maybe", F.coalesce(hit & F.col(id_col).isNotNull(), F.lit(False))).drop("sieve_part", "sieve_bits")


def with_id_in(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is among ``ids``; only rows that may be are shuffled."""
    return sifted(rows, ids, id_col).where("maybe").drop("maybe").join(ids.select(id_col).hint("shuffle_hash"), id_col, "left_semi").select(*rows.columns)


def without_id_in(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids``, rows without an id too; only rows that may be among them are shuffled."""
    both = sifted(rows, ids, id_col)
    rest = both.where("maybe").drop("maybe").join(ids.select(id_col).hint("shuffle_hash"), id_col, "left_anti").select(*rows.columns)
    return both.where("not maybe").select(*rows.columns).unionByName(rest)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its row offsets (n + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def passes(batch: pa.RecordBatch, column: str | int, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose text stays near ``limit`` bytes, whole documents always."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising mixer (the public splitmix64 constants), wrapping around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd base and its inverse modulo 2**64, for hashes of any byte range from one running sum.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    filled, step = 1, base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * np.uint64(step)
        filled += take
        step = step * step % (1 << 64)
    return out


_tables: dict[str, np.ndarray] = {}


def release() -> None:
    """Give back the memory that numpy, Arrow and the C library keep for reuse; workers live on after their tasks."""
    _tables.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with the worker's memory given back at the task's end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = 1 << int(max(n, 1 << 16) - 1).bit_length()
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["up"], _tables["down"]


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), equal for equal bytes wherever they stand."""
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2 * seed + 1)) * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(_BASE)))
