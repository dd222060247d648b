"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Texts are streams of whole code points, three spaces before each. All trusted documents, those whose
label says quality 1 and never 0, are counted: their 4-grams are summed by pass of text, and the sums
are shuffled by gram. From these counts the lower orders' continuation counts, the context totals and
the discounts are grouped. Below the single code points lies the uniform distribution over all of Unicode.

Documents are scored without sending the model anywhere. Each pass of about ``PASS_BYTES`` of text, whole
documents, asks for its distinct 4-grams; the distinct grams of all passes are joined to counts and
contexts order by order, sharded by gram, and the answers meet the pass they are for, its texts packed by zstandard, where each
document's bits per symbol (the binary logarithm of its perplexity) are summed up. Model and questions
grow with the text's variety. ``docs`` is read twice and must give the same passes, as a table does;
a pass whose answers are not those it asked for fails.

A document is rejected if its bits pass its language's bar: a high quantile of the bits of that
language's trusted documents plus ``SPREADS`` times the distance from their median to it. A short text's
bits vary more, so the bar is raised by ``SHORT`` / sqrt(symbols).

``symbol_table``, ``gram_stream``, ``count_grams`` and ``kneser_ney`` are the dense form of the model over 32 folded
symbols; no query uses it.

Defined cases: null and empty texts have no symbols, 0 bits, and are kept. Languages with no trusted
document, null among them, use the bar of all trusted documents; with no trusted text at all,
everything is kept. Repeated rows count each time. An empty table gives an empty result. Extra
columns are ignored by ``score_quality`` and kept by ``keep_quality``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import freeing, passes, release, table, text_bytes, with_id_in, without_id_in, written

ORDER = 4
BITS = 5
SYMBOLS = 1 << BITS
#: Bits of a code point in a gram's key; a 4-gram is a head and a tail of two code points each.
POINT = 21
POINTS = 0x110000
#: Values up to which a pass numbers its pairs and grams by a table instead of by sorting.
TABLE = 1 << 24
QUANTILE = 0.95
SPREADS = 3.0
SHORT = 6.0


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """The symbol of every code point up to 0xFFFF; the last one stands for all beyond."""
    out = np.full(0x10000, 31, np.uint8)
    for point in range(0x10000):
        c = chr(point)
        if c.isspace():
            out[point] = 0
        elif c.isalpha():
            base = unicodedata.normalize("NFD", c)[0]
            out[point] = 28 if c.isupper() else 1 + ord(base) - 97 if "a" <= base <= "z" else 27
        elif c.isdigit():
            out[point] = 29
        elif c in ".,;:'?()\"-":
            out[point] = 30
    return out


def gram_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram code ending at each symbol of all texts in a row, and how many each text has; three spaces stand before a text."""
    whole = [t or "" for t in texts]
    sizes = np.fromiter(map(len, whole), np.int64, len(whole))
    points = np.frombuffer("   ".join(["", *whole]).encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = symbol_table()[np.minimum(points, 0xFFFF)].astype(np.int32)
    codes = symbols[3:] | symbols[2:-1] << BITS | symbols[1:-2] << 2 * BITS | symbols[:-3] << 3 * BITS
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes + 3)[:-1] - 3
    inside[(ends[:, None] + np.arange(3)).ravel()] = False
    return codes[inside], sizes


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) over all rows of a one-column table of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            for part in passes(batch, "text"):
                total += np.bincount(gram_stream(part.column("text").to_pylist())[0], minlength=len(total))
        seen = np.flatnonzero(total)
        for k in range(0, len(seen), 1 << 16):
            some = seen[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["gram", "n"])

    return texts.select("text").mapInArrow(freeing(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts from the counts of counts; the usual halves where too few are known."""
    row = counts.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = row
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(float(k), max(0.05, d)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p): the interpolated probability of the last symbol after the others, for every possible gram of the order."""
    spark = grams.sparkSession
    counts = {order: grams}
    for n in range(order - 1, 0, -1):
        counts[n] = written(counts[n + 1].groupBy(F.col("gram").bitwiseAND((1 << BITS * n) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"continuations-{n}")
    lower = spark.range(1).select(F.lit(0).cast("long").alias("gram"), F.lit(1 / SYMBOLS).alias("p"))
    for n in range(1, order + 1):
        d1, d2, d3 = discounts(counts[n])
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = counts[n].select("gram", (F.col("n") - off).alias("rest"))
        context = counts[n].groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("freed"))
        every = spark.range(SYMBOLS**n).select(F.col("id").alias("gram"), F.shiftright("id", BITS).alias("context"), F.col("id").bitwiseAND((1 << BITS * (n - 1)) - 1).alias("short"))
        joined = every.join(own, "gram", "left").join(context, "context", "left").join(lower.select(F.col("gram").alias("short"), F.col("p").alias("p_short")), "short")
        p = F.when(F.col("total").isNull(), F.col("p_short")).otherwise((F.coalesce("rest", F.lit(0.0)) + F.col("freed") * F.col("p_short")) / F.col("total"))
        lower = joined.select("gram", p.alias("p"))
        if n < order:
            lower = written(lower, f"kneser-ney-{n}")
    return lower


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")


def numbered(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them; all are below ``limit``."""
    if limit > max(TABLE, 4 * len(values)):
        return np.unique(values, return_inverse=True)
    seen = np.zeros(limit, bool)
    seen[values] = True
    place = np.cumsum(seen, dtype=np.int32)
    place -= 1
    return np.flatnonzero(seen), place[values].astype(np.int64)


def point_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Heads and tails of the distinct 4-grams of all texts, ascending, which of them ends at each code point, and how many code points each text has."""
    whole = [t or "" for t in texts]
    sizes = np.fromiter(map(len, whole), np.int64, len(whole))
    alphabet, at = numbered(np.frombuffer("   ".join(["", *whole]).encode("utf-32-le", "surrogatepass"), "<u4"), POINTS)
    pairs, at = numbered(at[:-1] * len(alphabet) + at[1:], len(alphabet) ** 2)
    inside = np.ones(max(0, len(at) - 2), bool)
    inside[((np.cumsum(sizes + 3)[:-1] - 3)[:, None] + np.arange(3)).ravel()] = False
    grams, at = numbered((at[:-2] * len(pairs) + at[2:])[inside], len(pairs) ** 2)
    keys = alphabet[pairs // len(alphabet)].astype(np.int64) << POINT | alphabet[pairs % len(alphabet)].astype(np.int64)
    return keys[grams // len(pairs)], keys[grams % len(pairs)], at, sizes


def count_point_grams(texts: DataFrame) -> DataFrame:
    """(head, tail, n) over all rows of a one-column table of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                heads, tails, at, _ = point_grams(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(tails), pa.array(np.bincount(at, minlength=len(heads)), pa.int64())], ["head", "tail", "n"])

    return texts.select("text").mapInArrow(freeing(count), "head long, tail long, n long").groupBy("head", "tail").agg(F.sum("n").alias("n"))


def _suffix(n: int) -> tuple[Column, Column]:
    """Head and tail of a gram's last ``n`` code points, of one of ``n`` + 1."""
    low = (1 << POINT) - 1
    head = F.col("head").bitwiseAND(low) if n == 3 else F.lit(0).cast("long")
    return head, F.col("tail").bitwiseAND(low) if n == 1 else F.col("tail")


def point_probabilities(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """(head, tail, p): the interpolated probability of the last code point after the others, for every wanted 4-gram, from (head, tail, n)."""
    counts, need = {ORDER: grams}, {ORDER: wanted.select("head", "tail").distinct()}
    for n in range(ORDER - 1, 0, -1):
        head, tail = _suffix(n)
        counts[n] = written(counts[n + 1].groupBy(head.alias("head"), tail.alias("tail")).agg(F.count(F.lit(1)).alias("n")), f"continuations-{n}")
        need[n] = written(need[n + 1].select(head.alias("head"), tail.alias("tail")).distinct(), f"wanted-{n}")
    lower = None
    context = F.shiftright("tail", POINT)
    for n in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[n])
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = counts[n].select("head", "tail", (F.col("n") - off).alias("rest"))
        contexts = counts[n].groupBy("head", context.alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("freed"))
        every = need[n].withColumn("context", context).join(own, ["head", "tail"], "left").join(contexts, ["head", "context"], "left")
        if lower is None:
            every = every.withColumn("p_short", F.lit(1 / POINTS))
        else:
            head, tail = _suffix(n - 1)
            every = every.withColumn("s_head", head).withColumn("s_tail", tail).join(lower.select(F.col("head").alias("s_head"), F.col("tail").alias("s_tail"), F.col("p").alias("p_short")), ["s_head", "s_tail"])
        p = F.when(F.col("total").isNull(), F.col("p_short")).otherwise((F.coalesce("rest", F.lit(0.0)) + F.col("freed") * F.col("p_short")) / F.col("total"))
        lower = every.select("head", "tail", p.alias("p"))
        if n < ORDER:
            lower = written(lower, f"point-kneser-ney-{n}")
    return lower


def train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(head, tail, n): the 4-grams of all trusted documents."""
    trusted = with_id_in(docs.select("doc_id", "text").where(F.col("text") != ""), written(trusted_ids(labels), "trusted-ids"))
    return written(count_point_grams(trusted), "trusted-grams")


def _numbered_passes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Every pass of a task's text with a number of its own."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in passes(batch, "text"):
            yield number, part
            number += 1


def score_quality(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc_id, lang, n_symbols, bits): mean bits per symbol of every whole text; 0 bits where nothing is trusted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    if grams.isEmpty():
        return rows.select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_symbols"), F.lit(0.0).alias("bits"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in _numbered_passes(batches):
            heads, tails, _, _ = point_grams(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), number)), pa.array(heads), pa.array(tails)], ["pass", "head", "tail"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for number, part in _numbered_passes(batches):
            raw, ends = text_bytes(part.column("text"))
            row = {"pass": [number], "doc_ids": [part.column("doc_id")], "langs": [part.column("lang")], "ends": [ends[1:]], "packed": [zstandard.compress(raw.tobytes())]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("pass", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("ends", pa.list_(pa.int64())), ("packed", pa.binary())]))

    def score(placed: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        part = placed.slice(0, 1).to_pylist()[0]
        raw = zstandard.decompress(part["packed"])
        heads, tails, at, sizes = point_grams([raw[a:b].decode() for a, b in zip([0, *part["ends"][:-1]], part["ends"], strict=True)])
        head, tail, p = (answers.column(c).to_numpy() for c in ("head", "tail", "p"))
        order = np.lexsort((tail, head))
        if not (np.array_equal(head[order], heads) and np.array_equal(tail[order], tails)):
            raise RuntimeError("documents were not read the same way twice")
        each = -np.log2(p[order])[at]
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=each, minlength=len(sizes))
        release()
        return pa.table({"doc_id": pa.array(part["doc_ids"], pa.int64()), "lang": pa.array(part["langs"], pa.string()), "n_symbols": pa.array(sizes), "bits": pa.array(sums / np.maximum(1, sizes))})

    asked = written(rows.mapInArrow(freeing(ask), "pass long, head long, tail long"), "asked-grams")
    answers = asked.join(point_probabilities(grams, asked), ["head", "tail"]).select("pass", "head", "tail", "p")
    placed = rows.mapInArrow(freeing(place), "pass long, doc_ids array<long>, langs array<string>, ends array<long>, packed binary")
    return placed.groupBy("pass").cogroup(answers.groupBy("pass")).applyInArrow(score, "doc_id long, lang string, n_symbols long, bits double")


def bars(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, bar), one row for each language with trusted documents, and one with a null lang for all together."""
    known = scores.where("n_symbols > 0").join(trusted_ids(labels), "doc_id", "left_semi").where(F.col("lang").isNotNull())
    steady = F.col("bits") - SHORT / F.sqrt("n_symbols")
    return known.rollup("lang").agg(F.percentile_approx(steady, F.array(F.lit(0.5), F.lit(QUANTILE)), 10_000).alias("q")).select("lang", (F.col("q")[1] + SPREADS * (F.col("q")[1] - F.col("q")[0])).alias("bar"))


def judge(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with each document's bar and whether it is kept."""
    limits = {r["lang"]: r["bar"] for r in bars(scores, labels).collect()}  # one row a language
    everyone = limits.pop(None, None)
    bar = F.lit(everyone).cast("double")
    for lang, value in sorted(limits.items()):
        bar = F.when(F.col("lang") == lang, value).otherwise(bar)
    held = F.col("bits") - F.coalesce(SHORT / F.sqrt(F.when(F.col("n_symbols") > 0, F.col("n_symbols"))), F.lit(0.0))
    return scores.withColumn("bar", bar).withColumn("perplexity", F.pow(F.lit(2.0), F.col("bits"))).withColumn("kept", (F.col("n_symbols") == 0) | F.col("bar").isNull() | (held <= F.col("bar")))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, whole rows."""
    judged = judge(written(score_quality(docs, train(docs, labels)), "quality-scores"), labels)
    rejected = judged.where(~F.col("kept")).select("doc_id").distinct()
    return without_id_in(docs, written(rejected, "rejected"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(written(score_quality(docs, train(docs, labels)), "quality-scores"), labels)
