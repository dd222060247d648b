"""Near-duplicates: fast similarity sketches, banding, exact verification, connected components.

Words are runs of anything but white space, A-Z lower-cased; a document's set is its distinct
5-word shingles, or its whole word sequence if that is shorter. Two documents are linked if 100
times their sets' intersection is at least 75 times the union; a component is what links reach.

*Sketch.* In round i < T every shingle is thrown to one of T bins by that round's hash, in round
T + j all go to bin j; a bin keeps the least (round, hash). Rounds stop when every bin is filled, so
every coordinate is filled after at most 2 T rounds, a few for most texts, and coordinates agree
with a probability equal to the similarity, concentrated like independent draws.

*Banding.* ``BANDS`` bands of ``ROWS`` coordinates are hashed to bucket keys; at similarity 0.75 a
pair shares no bucket with probability (1 - 0.75**5)**40 = 2e-5.

*Verification.* Documents with equal sets are one class. Components grow in rounds: every bucket has a leader, a
member of its largest component, and every component is compared with one leader, of another component that it shares
many buckets with; a link joins the two. The first round takes a share of the buckets, later ones those that hold more
than one component, one member of each. Once few pairs across components are left that may be linked, or leaders find few links, the sketches of all of
them are compared, a tile of a bucket's members with a tile at a time; members of its largest component stay in their own tile.
A pair whose sketches agree in so few coordinates that it is five standard deviations below the limit, or whose sizes are
too far apart, is not linked; every other pair's full sets are intersected.

Defined cases: null and blank texts have an empty set, are linked with nothing and kept. Repeated
rows get a result row each; rows that repeat a ``doc_id`` with other texts are one node with the
links of all. Rows without a ``doc_id`` are linked with nothing, have no component and are kept. Ties do not
arise: the component's name is its least id. An empty table gives an
empty result. Extra columns are ignored by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import freeing, mix64, passes, range_hashes, table, text_bytes, without_id_in, written

SHINGLE = 5
PERCENT = 75
BANDS = 40
ROWS = 5
COORDINATES = BANDS * ROWS
#: Coordinates that a pair at the limit agrees in, less five standard deviations (a linked pair has fewer with a probability of 3e-7).
LEAST_AGREED = int(COORDINATES * PERCENT / 100 - 5 * (COORDINATES * PERCENT / 100 * (1 - PERCENT / 100)) ** 0.5)
#: The first round takes one bucket in so many; what it joins leaves later rounds little to compare.
FIRST_SHARE = 5
#: Rounds of leaders, at most, before the pairs across components that are left are all compared.
LEADER_ROUNDS = 8
#: Bucket members whose sketches are compared in one go; a member of a larger bucket goes to a row for each tile of it.
TILE = 512
#: Shingles of the documents whose full sets are compared in one go, about; a longer document is a block of its own.
BLOCK_SHINGLES = 1 << 16
#: Pairs that a task gathers before it hands them on.
GATHERED = 1 << 16
#: With no more pairs across components that are likely to be linked than this for each candidate document, or a smaller
#: share of links among the last leaders' pairs than this, no other round of leaders is worth its while.
FEW_PAIRS = 8
LEAST_YIELD = 1 / 16
#: Bytes of text that are sketched in one go; each takes some 100 bytes of numbers on the way.
SKETCH_BYTES = 1 << 19
#: Links that one task joins at once (16 bytes each); what more of them leave goes on by stars.
JOINED = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's end (n + 1 places)."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    raw = _LOWER[raw]
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    word = ~space
    begins = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], space[:-1])))) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((space[1:], [True])))) + 1 if len(raw) else np.zeros(0, np.int64)
    words = range_hashes(raw, begins, ends)
    owner = np.searchsorted(offsets, begins, side="right") - 1
    counts = np.bincount(owner, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    hashes = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        hashes += mix64(words[k : len(words) - SHINGLE + 1 + k] + _TURN[k]) if len(hashes) else np.uint64(0)
    hashes = mix64(hashes)
    whole = owner[: len(hashes)] == owner[SHINGLE - 1 :] if len(hashes) else np.zeros(0, bool)
    per_doc = np.maximum(0, counts - SHINGLE + 1)
    shorts = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    lengths = per_doc.copy()
    lengths[shorts] = 1
    at = np.concatenate(([0], np.cumsum(lengths)))
    out = np.empty(at[-1], np.uint64)
    is_short = np.zeros(at[-1], bool)
    is_short[at[shorts]] = True
    out[~is_short] = hashes[whole]
    for d in shorts.tolist():
        h = np.array([counts[d]], np.uint64) * _TURN[0]
        for k in range(first[d], first[d + 1]):
            h = mix64(h * _TURN[1] + words[k : k + 1] + np.uint64(1))
        out[at[d]] = h[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1][lengths > 0]] = True
    return out[fresh], np.concatenate(([0], np.cumsum(fresh)))[at]


def sketches(hashes: np.ndarray, at: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches [set, coordinate]; an empty set's stays unfilled."""
    n = len(at) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * size, empty, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    low = np.uint64((1 << 48) - 1)
    for i in range(2 * size):
        if not len(hashes):
            break
        v = mix64(hashes + np.uint64((i + 1) * int(_TURN[2]) % (1 << 64)))
        place = owner * size + ((v >> np.uint64(48)) * np.uint64(size) >> np.uint64(16)).astype(np.int64) if i < size else owner * size + (i - size)
        np.minimum.at(out, place, np.uint64(i << 48) | (v & low))
        open_ = (out.reshape(n, size) == empty).any(axis=1)
        if i < 4 or i % 8 == 0:
            stay = open_[owner]
            hashes, owner = hashes[stay], owner[stay]
    return out.reshape(n, size)


SKETCH_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, band_marks binary, sketch binary"


def sketch_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, band_marks, sketch): a set's size, its 128-bit digest, bucket keys, the low 32 bits of each, and one byte a coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text", SKETCH_BYTES):
                hashes, at = shingle_sets(part.column("text"))
                n = len(at) - 1
                table_ = sketches(hashes, at)
                keys = np.empty((n, BANDS), np.uint64)
                for b in range(BANDS):
                    h = np.full(n, b + 1, np.uint64)
                    for k in range(ROWS):
                        h = mix64(h * _TURN[3] + table_[:, b * ROWS + k])
                    keys[:, b] = h
                sizes = np.diff(at)
                sums = np.concatenate((np.zeros((1, 2), np.uint64), np.cumsum(np.stack([mix64(hashes ^ _TURN[0]), mix64(hashes ^ _TURN[4])], axis=1), axis=0, dtype=np.uint64)))
                digest = mix64((sums[at[1:]] - sums[at[:-1]]).ravel()).reshape(n, 2).view(np.int64)
                marks = np.ascontiguousarray(mix64(table_.ravel()).reshape(table_.shape).astype(np.uint8))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), lists, pa.array([m.tobytes() for m in keys.astype(np.uint32)], pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "band_marks", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), SKETCH_SCHEMA)


def _sizes_near(one, two, percent: int):
    """Whether sets of these sizes can be similar enough: an intersection is no larger than the smaller set, a union no smaller than the larger."""
    return 100 * np.minimum(one, two) >= percent * np.maximum(one, two)


def _agreeing(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sketch_a, sketch_b, n_shingles_a, n_shingles_b) that agree in enough coordinates to be tried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in (2, 3))
                near = (np.count_nonzero(one == two, axis=1) >= LEAST_AGREED) & _sizes_near(batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    return pairs.mapInArrow(freeing(run), "a long, b long")


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked; empty ones are not."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    found = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(found, len(large) - 1)] == small))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _intersected(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text_b", 1 << 20):
                one, two = part.column(2).to_pylist(), part.column(3).to_pylist()
                place = {t: k for k, t in enumerate(dict.fromkeys(one + two))}
                hashes, at = shingle_sets(pa.array(list(place), pa.string()))
                sets = {t: hashes[at[k] : at[k + 1]] for t, k in place.items()}
                keep = [_similar(sets[x], sets[y], percent) for x, y in zip(one, two, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(freeing(run), "a long, b long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (a, b) links what connects the same, ``JOINED`` of them at a time: each node with the least one that it reaches among them."""
    held, size = [], 0
    for batch in batches:
        for low in range(0, batch.num_rows, JOINED):
            part = batch.slice(low, JOINED)
            if size + part.num_rows > JOINED:
                yield _stars(held)
                held, size = [], 0
            held.append(np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], axis=1))
            size += part.num_rows
    if size:
        yield _stars(held)


def _stars(held: list[np.ndarray]) -> pa.RecordBatch:
    links = np.concatenate(held)
    nodes, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(links.shape).T
    least = np.arange(len(nodes))
    while True:
        # hook the roots of linked nodes to the lesser one, then halve paths until all point at roots
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
        if (least == before).all():
            break
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], ["u", "v"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link (a, b), which should be written rows; the component is its least node. Tasks join what
    they hold; if one task doesn't hold all, stars are moved to smaller hubs until none moves."""
    pairs = links.select("a", "b").where("a <> b")
    tasks = -(-pairs.count() // JOINED)
    edges = written(pairs.coalesce(max(1, tasks)).mapInArrow(freeing(_forest), "u long, v long"), "edges")
    if tasks > 1:
        edges = _by_stars(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _by_stars(edges: DataFrame) -> DataFrame:
    """(u, v) edges from each node to its component's least node, from edges with u > v that connect the same."""
    summed = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = edges.distinct()
    now, before = summed(edges), None
    while now[0] and now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("hub"))
        large = both.where("v > u").join(hubs, "u").select(F.col("v").alias("u"), F.col("hub").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("hub"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("hub").alias("v")), F.struct(F.col("v").alias("u"), F.col("hub").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small, "edges")
        before, now = now, summed(edges)
    return edges


def _leaders(members: DataFrame, round_: int) -> DataFrame:
    """(a, b): for each component of bucket members (key, doc_id, component) one member and one of another component, which
    leads buckets that both are in. The more buckets they share, the likelier is that pair; no component has two pairs."""
    luck = F.xxhash64(F.lit(round_), "doc_id")
    one = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(luck.alias("luck"), "doc_id")).getField("doc_id").alias("doc_id")) if round_ else members.withColumn("n", F.lit(1).cast("long"))
    heads = one.groupBy("key").agg(F.max(F.struct("n", F.xxhash64(F.lit(round_), "component").alias("luck"), "component", "doc_id")).alias("head"))
    met = one.join(heads, "key").where("component <> head.component")
    shared = met.groupBy("component", F.col("head.component").alias("other")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", F.col("head.doc_id").alias("lead"))).alias("pair"))
    weight = F.col("n") * (F.pmod(F.xxhash64(F.lit(round_), "component", "other"), F.lit(1 << 20)) + 1)
    return shared.groupBy("component").agg(F.max(F.struct(weight.alias("weight"), "pair")).alias("best")).select(F.col("best.pair.doc_id").alias("a"), F.col("best.pair.lead").alias("b"))


def _tiles(members: DataFrame) -> DataFrame:
    """Rows of at most about two tiles of a bucket's members; every two members of a bucket that are not both of its largest component meet in some row.

    A member of the largest component goes to a row for each tile of the rest, one as a rule; a member of the rest to a row for each tile."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("top.n").alias("n_top")).select("key", F.ceil(F.col("n_top") / TILE).alias("tops"), F.ceil((F.col("n") - F.col("n_top")) / TILE).alias("rests"))
    of_top = F.col("component") == F.col("top.component")
    draw = F.xxhash64("doc_id")
    dealt = members.join(sizes, "key").withColumn("tile", F.when(of_top, F.pmod(draw, F.col("tops"))).otherwise(F.col("tops") + F.pmod(draw, F.col("rests"))))
    met = dealt.withColumn("other", F.explode(F.sequence(F.when(of_top, F.col("tops")).otherwise(F.lit(0).cast("long")), F.col("tops") + F.col("rests") - 1)))
    rows = met.groupBy("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")).agg(F.collect_list(F.struct("doc_id", "component", "n_shingles", "sketch", "bands", "block")).alias("met"))
    return rows.where(F.size(F.array_distinct(F.transform("met", lambda m: m["component"]))) > 1).select("key", "met")


def _blocks(members: DataFrame) -> DataFrame:
    """(doc_id, block) of bucket members (doc_id, key, top, n_shingles): documents by the largest bucket that they are in, in parts of about ``BLOCK_SHINGLES``."""
    home = members.groupBy("doc_id").agg(F.max(F.struct("n_members", "key")).getField("key").alias("home"), F.max("n_shingles").alias("n"))
    sizes = home.groupBy("home").agg(F.sum("n").alias("total"))
    return home.join(sizes, "home").select("doc_id", F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("total") / BLOCK_SHINGLES))).alias("block"))


def _by_blocks(found: list[np.ndarray]) -> pa.RecordBatch:
    """(block_a, block_b, pairs) from rows of pairs (block_a, block_b, a, b)."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    cuts = np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(axis=1)) + 1
    starts = np.concatenate(([0], cuts))
    pairs = pa.StructArray.from_arrays([pa.array(rows[:, 2].copy()), pa.array(rows[:, 3].copy())], ["a", "b"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate((starts, [len(rows)])), pa.int32()), pairs)
    return pa.RecordBatch.from_arrays([pa.array(rows[starts, 0]), pa.array(rows[starts, 1]), lists], ["block_a", "block_b", "pairs"])


def _across(tiles: DataFrame, percent: int) -> DataFrame:
    """(block_a, block_b, pairs) of the pairs (a, b) of a row's members in different components whose sketches agree enough, by their blocks.

    A pair that shares several buckets is taken from the first band that it shares one in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for key, row in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                met = row.values
                ids, of, n, block = (met.field(k).to_numpy() for k in ("doc_id", "component", "n_shingles", "block"))
                marks = np.frombuffer(b"".join(met.field("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
                bands = np.frombuffer(b"".join(met.field("bands").to_pylist()), np.int32).reshape(-1, BANDS)
                band = int(np.argmax(bands[0] == np.int64(key).astype(np.int32)))
                for k in range(len(ids) - 1):
                    rest = np.flatnonzero((of[k + 1 :] != of[k]) & _sizes_near(n[k + 1 :], n[k], percent)) + k + 1
                    rest = rest[~(bands[rest, :band] == bands[k, :band]).any(axis=1)]
                    rest = rest[np.count_nonzero(marks[rest] == marks[k], axis=1) >= LEAST_AGREED]
                    if len(rest):
                        pairs = np.stack([np.full(len(rest), block[k]), block[rest], np.full(len(rest), ids[k]), ids[rest]], axis=1)
                        turned = pairs[:, 0] > pairs[:, 1]
                        pairs[turned] = pairs[turned][:, [1, 0, 3, 2]]
                        found.append(pairs)
                        held += len(pairs)
                if held >= GATHERED:
                    yield _by_blocks(found)
                    found, held = [], 0
        if held:
            yield _by_blocks(found)

    return tiles.mapInArrow(freeing(run), "block_a long, block_b long, pairs array<struct<a: long, b: long>>")


def _linked(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, pairs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (id, id) whose sets are similar enough. An id may stand for several sets."""
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[order], pairs, side=x) for x in ("left", "right"))
    if (high - low > 1).any():
        places = np.array([(order[p], order[q]) for (x, y), (u, v) in zip(low.tolist(), high.tolist(), strict=True) for p in range(x, u) for q in range(y, v)])
    else:
        places = order[low]
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(ids)), sizes)
    _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
    # only shingles of two sets or more can be in an intersection; a row of bits for each set says which it has
    number = np.cumsum(times > 1) - 1
    shared = times[which] > 1
    width = int(number[-1]) + 1 if len(number) else 0
    bits = np.zeros((len(ids), -(-width // 64) * 8), np.uint8)
    np.bitwise_or.at(bits, (owner[shared], number[which[shared]] >> 3), np.left_shift(1, number[which[shared]] & 7).astype(np.uint8))
    words = bits.view(np.uint64)
    parent = {int(d): int(d) for d in ids}

    def root(d: int) -> int:
        while parent[d] != d:
            parent[d] = d = parent[parent[d]]
        return d

    out = []
    step = max(1, (4 << 20) // max(1, bits.shape[1]))
    for k in range(0, len(places), step):
        one, two = places[k : k + step, 0], places[k : k + step, 1]
        both = np.bitwise_count(words[one] & words[two]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero((100 * both >= percent * (sizes[one] + sizes[two] - both)) & (both > 0))
        for x, y in zip(ids[one[near]].tolist(), ids[two[near]].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[p] = q
                out.append((x, y))
    return out


def _intersected_by_block(tried: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of (block_a, block_b, pairs) links that connect what the pairs with similar full sets do; a text goes to each two blocks with pairs of it once, not to each pair."""
    keys = ("block_a", "block_b")
    pairs = written(tried.groupBy(*keys).agg(F.flatten(F.collect_list("pairs")).alias("pairs")), "block-pairs")
    who = pairs.select(*keys, F.explode(F.array_union(F.col("pairs.a"), F.col("pairs.b"))).alias("doc_id"))
    what = who.join(texts, "doc_id").groupBy(*keys).agg(F.collect_list(F.struct("doc_id", "text")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for two, what in zip(batch.column(0), batch.column(1), strict=True):
                met = what.values
                hashes, at = shingle_sets(met.field("text"))
                asked = np.stack([two.values.field(k).to_numpy() for k in ("a", "b")], axis=1)
                kept = _linked(met.field("doc_id").to_numpy(), hashes, at, asked, percent)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], ["a", "b"])

    return pairs.join(what, list(keys)).select("pairs", "texts").mapInArrow(freeing(run), "a long, b long")


def _torn(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links of ids whose rows have different sets with the representatives of those sets."""
    digest = F.struct("set_a", "set_b")
    torn = filled.groupBy("doc_id").agg(F.min(digest).alias("one"), F.max(digest).alias("two")).where("one <> two").select("doc_id")
    return filled.join(torn, "doc_id", "left_semi").select("doc_id", "set_a", "set_b").distinct().join(classes, ["set_a", "set_b"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def link_components(docs: DataFrame, sketched: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """(rep, component) of every class representative that links with another class."""
    filled = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    bands = filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key")
    members = written(bands.join(shared, "key", "left_semi").withColumn("component", F.col("doc_id")), "buckets")
    candidates = written(members.select("doc_id").distinct(), "candidates")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(candidates.hint("shuffle_hash"), "doc_id", "left_semi")
    texts = written(whole.groupBy("doc_id", F.xxhash64("text")).agg(F.first("text").alias("text")).select("doc_id", "text"), "candidate-texts")
    marks = written(filled.join(candidates, "doc_id", "left_semi").groupBy("doc_id", "set_a", "set_b").agg(F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.first("band_marks").alias("bands")).select("doc_id", "sketch", "n_shingles", "bands"), "candidate-sketches")
    side = lambda df, k, *cols: df.select(F.col("doc_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in cols))

    n_candidates, alike = candidates.count(), 1.0
    components = connected_components(written(_torn(filled, classes), "torn"))
    for round_ in range(LEADER_ROUNDS + 1):
        across = 0
        if round_:
            members = members.select("key", "doc_id").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            members = written(members, f"labelled-{round_}")
            # of a bucket: members n, the pairs of them across components, from the sizes of its components
            sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max(F.struct("n", "component")).alias("top"))
            split = written(sizes.withColumn("across", (F.col("n") * F.col("n") - F.col("same")) / 2).where("across > 0").select("key", "across", "top", F.col("n").alias("n_members")), f"split-{round_}")
            across = split.agg(F.sum("across")).first()[0] or 0
            if not across:
                break
            members = members.join(split.select("key", "top", "n_members"), "key")
        # of the pairs that are left about as large a share is linked as of those with the last leaders
        last = round_ > 0 and (round_ == LEADER_ROUNDS or alike < LEAST_YIELD or float(across) * alike <= FEW_PAIRS * n_candidates)
        if last:
            marked = members.join(marks, "doc_id")
            tried = _across(_tiles(marked.join(_blocks(marked.select("doc_id", "key", "n_members", "n_shingles")), "doc_id")), percent)
            found = _intersected_by_block(tried, texts, percent)
        else:
            pairs = written(_leaders(members if round_ else members.where(F.pmod("key", F.lit(FIRST_SHARE)) == 0), round_), f"pairs-{round_}")
            met = pairs.join(side(marks, "a", "sketch", "n_shingles"), "a").join(side(marks, "b", "sketch", "n_shingles"), "b")
            tried = _agreeing(met.select("a", "b", "sketch_a", "sketch_b", "n_shingles_a", "n_shingles_b"), percent)
            full = tried.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b").select("a", "b", "text_a", "text_b")
            found = _intersected(full, percent)
        found = written(found, f"links-{round_}")
        components = connected_components(found.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if last:
            break
        alike = found.count() / max(1, pairs.count())
    return components.select(F.col("node").alias("rep"), "component")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = written(sketch_documents(docs), "sketches")
    components = link_components(docs, sketched, percent=percent)
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = sketched.where(linkable).groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    named = classes.join(components, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("named"))
    rows = sketched.select("doc_id", "n_shingles", "set_a", "set_b")
    out = rows.where(linkable).join(named, ["set_a", "set_b"]).select("doc_id", "n_shingles", F.col("named").alias("component_id")).unionByName(rows.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, whole rows: the one with the least id."""
    gone = written(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "duplicates")
    return without_id_in(docs, gone)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
