"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents are laid end to end in a pseudorandom order and cut into blocks of a fixed
number of words. The mix is a row of output shards of ``SHARD_SLOTS`` block slots each. For every shard the
counts of its sources are a multinomial draw: each slot draws a source by the targets' shares. The draws of all
shards decide how many slots a source gets, as long as that is within ``NEAR`` of its target and within two
passes over it. Over all shards draws miss the targets by about the root of the slots, so sources of many slots
keep theirs; what a small source was drawn too often beyond that is taken from its draws at even distances and goes, in
the same shards, to the sources drawn too rarely. Running sums over the shards then number a source's slots. Slot j of a source
takes the block that a pseudorandom permutation of the source's block numbers (one permutation for
each pass over the source) maps it to; slots and blocks then join by block number. As no slot count
exceeds two passes, no word is taken more than twice.

The permutation is a swap-or-not shuffle: in each round the number x is exchanged with K - x (modulo
the number of blocks) if a hash of the larger of the two says so; every round is its own inverse, so
the whole is a permutation for any number of blocks.

Places in a source come from running sums within hashed buckets and running sums over the buckets,
about the square root of the rows in number, so no task holds a whole source; those of slots from running sums within and over groups of ``GROUP`` shards.

Defined cases: null and empty texts have size 0 and are taken 0 times. A null source is a source of
its own, last in order. Rows are told apart by a hash of id, text and source and, where these are equal, by a
running number, so repeated rows and null or repeated ids are rows like others. An empty table gives an empty result. Extra
columns are ignored by ``mix_counts`` and kept by ``mix_documents``. Ties of any kind are broken by hashes; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 128
#: Blocks that a source is cut into at least, where it has the words.
LEAST_BLOCKS = 1024
#: Share of a source's slots by which the draws may miss its target.
NEAR = 0.01
SHARD_SLOTS = 4096
#: Shards that one task draws and permutes, about.
SHARDS_A_TASK = 8
#: Shards whose counts are summed up in one go.
GROUP = 1024
#: Parts of the unit interval by which a drawn number finds its source.
BINS = 1024
ROUNDS = 16
SEED = 20


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; no words for null or blank texts."""
    flat = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(F.length(flat), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, sid, source_size, target, words a block, blocks, slots), one row a source, from (source, size) rows."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("sid", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    # a source is full when the level, in words per weight, passes this; all fuller ones before it are at their limit
    full = ranked.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * float(repeats)).withColumn("fills", F.col("limit") / F.col("weight"))
    before = W.orderBy("fills", "sid").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    target = F.least(F.col("limit"), F.max("level").over(whole) * F.col("weight"))
    out = full.withColumn("level", level).withColumn("target", target)
    size = F.col("source_size")
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(size / LEAST_BLOCKS))).cast("long")
    blocks = F.ceil(size / F.col("block_words")).cast("long")
    slots = F.when(size > 0, F.least(F.col("blocks") * repeats, F.round(F.col("target") * F.col("blocks") / size))).otherwise(0).cast("long")
    return out.withColumn("block_words", block).withColumn("blocks", blocks).withColumn("slots", slots).select("source", "sid", "source_size", "target", "block_words", "blocks", "slots")


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 .. n - 1 named by ``key``."""

    def swap(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(seed), *key, r), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(seed + 1), *key, r, F.greatest(at, mirror)), F.lit(2)) == 1, mirror).otherwise(at)

    return F.aggregate(F.array(*(F.lit(r) for r in range(rounds))), x, swap)


def _slots_of(targets: DataFrame) -> int:
    return targets.agg(F.sum("slots")).first()[0] or 0


def _shard_tasks(shards: int) -> int:
    return max(1, min(8192, -(-shards // SHARDS_A_TASK)))


def draw_counts(targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, sid, n): a multinomial draw of source counts for each output shard."""
    spark = targets.sparkSession
    total = _slots_of(targets)
    shards = -(-total // SHARD_SLOTS)
    before = F.coalesce(F.sum("slots").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the slots of all sources in a row are the interval that is drawn from; a source lies in some of its bins
    ranges = targets.where(F.col("slots") > 0).select("sid", before.alias("low"), (before + F.col("slots")).alias("high"))
    part = lambda x: F.floor(x * BINS / max(1, total)).cast("long")
    bins = ranges.withColumn("bin", F.explode(F.sequence(part(F.col("low")), part(F.col("high") - 1))))
    runs = spark.range(0, shards, 1, _shard_tasks(shards)).withColumnRenamed("id", "shard")
    slots = runs.withColumn("slot", F.explode(F.sequence(F.col("shard") * SHARD_SLOTS, F.least((F.col("shard") + 1) * SHARD_SLOTS, F.lit(total)) - 1)))
    drawn = slots.select("shard", F.pmod(F.xxhash64(F.lit(seed + 2), "slot"), F.lit(max(1, total))).alias("at"))
    met = drawn.withColumn("bin", part(F.col("at"))).join(bins, "bin").where("at >= low and at < high")
    return met.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def _numbered(counts: DataFrame) -> DataFrame:
    """Counts (shard, sid, n) with ``start``, the sum of the source's counts in all shards before."""
    group = F.floor(F.col("shard") / GROUP)
    sums = counts.groupBy("sid", group.alias("group")).agg(F.sum("n").alias("n"))
    offsets = sums.select("sid", "group", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = W.partitionBy("sid", "group").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    local = counts.withColumn("group", group).withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return local.join(offsets, ["sid", "group"]).select("shard", "sid", "n", (F.col("start") + F.col("offset")).alias("start"))


def settled_draws(sums: DataFrame, near: float = NEAR) -> DataFrame:
    """(sid, drawn, mixed) from (sid, slots, blocks, drawn): the slots that each source gets, as many in all as were drawn.

    A source gets what it was drawn, but no more and no fewer than ``near`` of its slots allow, and no more than two passes; what
    that leaves over or short is made up in order of the sources that have room.
    """
    order, whole = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    room = F.floor(F.col("slots") * near).cast("long")
    bounds = sums.withColumn("low", F.col("slots") - room).withColumn("high", F.least(F.col("slots") + room, F.col("blocks") * REPEATS))
    held = bounds.withColumn("held", F.greatest("low", F.least("high", "drawn"))).withColumn("up", F.col("high") - F.col("held")).withColumn("down", F.col("held") - F.col("low"))
    short = held.withColumn("short", F.sum(F.col("drawn") - F.col("held")).over(whole)).withColumn("ups", F.coalesce(F.sum("up").over(order), F.lit(0))).withColumn("downs", F.coalesce(F.sum("down").over(order), F.lit(0)))
    share = lambda amount, room, before: F.greatest(F.lit(0), F.least(F.col(room), amount - F.col(before)))
    return short.select("sid", "drawn", (F.col("held") + share(F.col("short"), "up", "ups") - share(-F.col("short"), "down", "downs")).alias("mixed"))


def shard_counts(targets: DataFrame) -> DataFrame:
    """(shard, sid, n, start): the source counts of each output shard, drawn, each source's sum near its slots; ``start`` numbers them over the shards."""
    drawn = written(draw_counts(targets), "mix-drawn")
    sums = targets.join(drawn.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left").select("sid", "slots", "blocks", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    order = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    over, under = F.greatest(F.lit(0), F.col("drawn") - F.col("mixed")), F.greatest(F.lit(0), F.col("mixed") - F.col("drawn"))
    plan = settled_draws(sums).withColumn("over", over).withColumn("under", under).withColumn("over_at", F.coalesce(F.sum("over").over(order), F.lit(0))).withColumn("under_at", F.coalesce(F.sum("under").over(order), F.lit(0)))
    plan = written(plan, "mix-fit")  # one row a source
    fitted = _numbered(drawn).join(plan.select("sid", "drawn", "over", "over_at"), "sid")
    gone = lambda x: F.floor(x * F.col("over") / F.col("drawn")).cast("long")
    cut = fitted.withColumn("from", gone(F.col("start").cast("decimal(38,0)"))).withColumn("to", gone((F.col("start") + F.col("n")).cast("decimal(38,0)")))
    freed = cut.where(F.col("to") > F.col("from")).select("shard", F.explode(F.sequence(F.col("over_at") + F.col("from"), F.col("over_at") + F.col("to") - 1)).alias("unit"))
    wanted = plan.where("under > 0").select("sid", F.explode(F.sequence(F.col("under_at"), F.col("under_at") + F.col("under") - 1)).alias("unit"))
    moved = freed.join(wanted, "unit").select("shard", "sid", F.lit(1).cast("long").alias("n"))
    kept = cut.select("shard", "sid", (F.col("n") - (F.col("to") - F.col("from"))).alias("n"))
    final = kept.unionByName(moved).groupBy("shard", "sid").agg(F.sum("n").alias("n")).where("n > 0")
    return _numbered(written(final, "mix-counts"))


def draw_slots(targets: DataFrame) -> DataFrame:
    """All slots of the mix: (shard, sid, slot, block)."""
    counts = shard_counts(targets).join(targets.select("sid", "blocks"), "sid")
    # a row of counts is few bytes but becomes thousands of slots, so rows are dealt by number, not by bytes
    counts = counts.repartition(_shard_tasks(-(-_slots_of(targets) // SHARD_SLOTS)), "shard")
    slots = counts.withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("sid"), F.floor(F.col("slot") / F.col("blocks")))
    return slots.select("shard", "sid", "slot", block.alias("block"))


def _placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (row_key, source, size) with their source's numbers and their first word's place in it."""
    n_rows = rows.count()
    buckets = max(1, int(n_rows**0.5))
    keyed = rows.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED + 3), "row_key"), F.lit(buckets)))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = W.partitionBy("sid", "bucket").orderBy("row_key", "size").rowsBetween(W.unboundedPreceding, -1)
    local = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return local.join(offsets.hint("merge"), ["sid", "bucket"]).withColumn("start", F.col("offset") + F.col("before")).drop("offset", "before", "bucket")


def _pieces(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each block that a row's words lie in, with the words there and how often the mix's shards take the block."""
    times = draw_slots(targets).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    b = F.col("block_words")
    spread = placed.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    begin, end = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    cut = spread.withColumn("first", begin - F.col("start")).withColumn("words", end - begin)
    return cut.join(times.hint("merge"), ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def _row_key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _row_key(id_col, text_col, source_col).alias("row_key"), F.size(word_array(F.col(text_col))).cast("long").alias("size")), "mix-sizes")
    # one row a source, written once as many branches read it
    targets = written(source_targets(rows), "mix-targets")
    return _placed(rows, targets), targets


def mix_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its size, its source's size and target, and the words of it that the mix takes."""
    placed, targets = _plan(docs, id_col, text_col, source_col)
    pieces = _pieces(placed, targets)
    same = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    # within a source no two rows with words start at the same place
    taken = pieces.groupBy("sid", "start").agg(*same, F.sum(F.col("words") * F.col("times")).alias("taken"))
    empty = placed.where(F.col("size") == 0).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.select(*empty.columns).unionByName(empty)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each document's text is what the mix takes of it, one pass after the other; documents that it takes nothing of go."""
    placed, targets = _plan(docs, "doc_id", "text", "source")
    docs = docs.withColumn("mix_key", _row_key("doc_id", "text", "source"))
    keys = ["mix_key"]
    placed = placed.withColumnRenamed("row_key", "mix_key")
    if not placed.groupBy("mix_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # rows that are equal in id, text and source: any numbering of them will do
        copy = F.row_number().over(W.partitionBy("mix_key").orderBy("mix_key"))
        docs, keys = docs.withColumn("mix_copy", copy), [*keys, "mix_copy"]
        placed = placed.withColumn("mix_copy", F.row_number().over(W.partitionBy("mix_key").orderBy("start")))
    parts = _pieces(placed, targets).where(F.col("times") > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "words", "times"))).alias("mix_parts"), F.sum(F.col("words")).alias("mix_once"), F.sum(F.when(F.col("times") > 1, F.col("words")).otherwise(0)).alias("mix_twice"))
    words = word_array(F.col("text"))

    def taken(times: int) -> Column:
        parts = F.filter("mix_parts", lambda p: p["times"] >= times)
        return F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(F.col("mix_words"), (p["first"] + 1).cast("int"), p["words"].cast("int")))), " ")

    joined = docs.join(parts.hint("shuffle_hash"), keys).withColumn("mix_words", words)
    size = F.size("mix_words")
    first = F.when(F.col("mix_once") == size, F.col("text")).otherwise(taken(1))
    second = F.when(F.col("mix_twice") == 0, F.lit(None)).when(F.col("mix_twice") == size, F.col("text")).otherwise(taken(2))
    text = F.concat_ws("\n", first, second)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(c for c in docs.columns if not c.startswith("mix_")))


def mix_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(shard, source, slot, block, text): the mix as its shards' slots, each with the words of the block that it takes, joined by block index."""
    placed, targets = _plan(docs, id_col, text_col, source_col)
    b = F.col("block_words")
    texts = docs.select(_row_key(id_col, text_col, source_col).alias("row_key"), word_array(F.col(text_col)).alias("all_words")).dropDuplicates(["row_key"])
    spread = placed.where(F.col("size") > 0).join(texts, "row_key").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    begin, end = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    cut = spread.select("sid", "block", begin.alias("begin"), F.slice("all_words", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")).alias("words"))
    blocks = cut.groupBy("sid", "block").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "words"))), lambda x: x["words"])), " ").alias("text"))
    return draw_slots(targets).join(blocks, ["sid", "block"]).join(targets.select("sid", "source"), "sid").select("shard", "source", "slot", "block", "text")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
