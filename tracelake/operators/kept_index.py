"""A kept inverted index: postings in term buckets, segment by segment, so that a search reads its terms' buckets and no text.

``<root>/postings/segment=N/bucket=K`` has (term, key, tf, length), ``docs/segment=N`` each text's length, ``dead/segment=N`` which
(key, segment) the segment replaces or takes out, ``commits/segment=N`` one row of totals, written last: a segment counts from then
on, and one that was cut off is written again under its number. A text that is put in again takes the place of the former one.
``compact`` writes what is live as one segment and leaves the earlier ones behind.

A key stands for one text; of repeated rows of a key in one call the one of the least text counts. A null text counts as a text
without a length, a text without words has the length 0. Rows without a key can't be replaced or taken out.
"""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.filters import clamp_limit
from tracelake.operators import search

#: Buckets of terms, and parts into which the rows of one bucket are dealt when they are written.
BUCKETS, PARTS = 64, 8
#: Words that a task counts or sorts, about; tasks and parts grow with the texts, what one task holds does not.
TASK_WORDS = 1 << 20
_TOTALS = "n_texts long, n_lengths long, total_length long, since int"


def _bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def _bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _tasks(n_words: int) -> int:
    return max(1, -(-n_words // TASK_WORDS))


class KeptIndex:
    """An index under one folder that driver and executors share, for keys of one type."""

    def __init__(self, spark: SparkSession, root: str, key: str = "key", key_type: str = "long"):
        self.spark, self.root, self.key, self.key_type = spark, root.rstrip("/"), key, key_type

    def _read(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def last(self):
        """The totals of the last commit; None for an empty index."""
        return self._read("commits", f"{_TOTALS}, segment int").orderBy(F.desc("segment")).first()

    def _live(self, folder: str, schema: str) -> DataFrame:
        """Rows of committed segments that no later one has replaced. What is dead is small: it grows with the edits since the last ``compact``."""
        last = self.last()
        since, until = (last.since, last.segment) if last else (0, -1)
        rows = self._read(folder, f"{schema}, segment int").where(F.col("segment").between(since, until))
        dead = self._read("dead", f"{self.key} {self.key_type}, dead_in int, segment int").where(F.col("segment").between(since, until))
        return rows.join(dead.select(self.key, F.col("dead_in").alias("segment")), [self.key, "segment"], "left_anti")

    def docs(self) -> DataFrame:
        """(segment, key, length) of every text in the index."""
        return self._live("docs", f"{self.key} {self.key_type}, length int")

    def postings(self) -> DataFrame:
        return self._live("postings", f"term string, {self.key} {self.key_type}, tf long, length int, bucket int")

    def _write(self, words: DataFrame, segment: int, tasks: int) -> None:
        parts = max(PARTS, -(-tasks // BUCKETS))
        # what is the same in all rows of a text stands together, so that the shuffle packs it well
        rows = words.select(self.key, "length", "tf", "term").repartition(tasks, _bucket(F.col("term")), F.pmod(F.xxhash64(self.key), F.lit(parts)))
        dealt = rows.withColumn("bucket", _bucket(F.col("term")))
        dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/postings/segment={segment}")

    def _commit(self, segment: int, docs: DataFrame, dead: DataFrame, before, since: int) -> int:
        docs.select(self.key, "length").write.mode("overwrite").parquet(f"{self.root}/docs/segment={segment}")
        gone_rows = dead.select(self.key, F.col("segment").alias("dead_in"), "length")
        gone_rows.write.mode("overwrite").parquet(f"{self.root}/dead/segment={segment}")
        sums = [F.count(F.lit(1)).alias("n"), F.count("length").alias("lengths"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")]
        new = self.spark.read.parquet(f"{self.root}/docs/segment={segment}").agg(*sums).first()
        gone = self.spark.read.parquet(f"{self.root}/dead/segment={segment}").agg(*sums).first()
        old = (before.n_texts, before.n_lengths, before.total_length) if before else (0, 0, 0)
        totals = tuple(o + n - g for o, n, g in zip(old, new, gone, strict=True))
        self.spark.createDataFrame([(*totals, since)], _TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/segment={segment}")
        return segment

    def put(self, texts: DataFrame, text: str, removed: DataFrame | None = None) -> int:
        """Put texts in, in place of those of the same keys, and take the keys of ``removed`` out; the number of the new segment."""
        last = self.last()
        segment = last.segment + 1 if last else 0
        rows = texts.select(F.col(self.key).cast(self.key_type).alias(self.key), F.col(text).alias("text"))
        # rows without a key are told apart; the counts below go by the same keys, so that texts are dealt once and words are not
        own = F.when(F.col(self.key).isNull(), F.monotonically_increasing_id()).alias("own")
        # a word and the gap behind it take some six characters
        tasks = _tasks((texts.agg(F.sum(F.length(text))).first()[0] or 0) // 6)
        rows = rows.withColumn("own", own).repartition(tasks, self.key, "own").groupBy(self.key, "own").agg(F.min("text").alias("text"))
        touched = rows.select(self.key) if removed is None else rows.select(self.key).unionByName(removed.select(F.col(self.key).cast(self.key_type).alias(self.key)))
        dead = self.docs().join(touched.distinct(), self.key, "left_semi")
        words = rows.select(self.key, "own", search.tokens(F.col("text")).alias("words"))
        # the empty term, which no query asks for, stands once for each text
        terms = F.concat(F.coalesce("words", F.array().cast("array<string>")), F.array(F.lit("")))
        places = words.select(self.key, "own", F.size("words").alias("length"), F.explode(terms).alias("term"))
        counts = places.groupBy(self.key, "own", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
        self._write(counts.select("term", self.key, "tf", "length"), segment, tasks)
        written = self._read("postings", f"term string, {self.key} {self.key_type}, length int, segment int, bucket int")
        lengths = written.where((F.col("segment") == segment) & (F.col("bucket") == _bucket_of("")) & (F.col("term") == ""))
        return self._commit(segment, lengths, dead, last, last.since if last else 0)

    def compact(self) -> int:
        """What is live as one segment."""
        last = self.last()
        if last is None:
            return -1
        segment = last.segment + 1
        self._write(self.postings().select("term", self.key, "tf", "length"), segment, _tasks(last.total_length))
        none = self.docs().limit(0)
        return self._commit(segment, self.docs(), none, None, segment)

    def bm25(self, query: str, *, limit: int = 20, among: DataFrame | None = None) -> DataFrame:
        """(key, rank) as ``search.bm25`` over all live texts; ``among`` holds the keys that may be found, before the limit."""
        terms, last = sorted(set(query.lower().split())), self.last()
        if not terms or last is None:
            return self.spark.createDataFrame([], f"{self.key} {self.key_type}, rank double")
        found = self.postings().where(F.col("bucket").isin(sorted({_bucket_of(t) for t in terms})) & F.col("term").isin(terms))
        df = {r.term: r.n for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each term of the query
        tf = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]
        every = found.groupBy("segment", self.key, "length").agg(*tf).where(" AND ".join(f"tf{i} IS NOT NULL" for i in range(len(terms))))
        if among is not None:
            every = every.join(among.select(self.key), self.key, "left_semi")
        mean = last.total_length / last.n_lengths if last.n_lengths else None
        score = search.bm25_score(last.n_texts, mean, [df.get(t, 0) for t in terms])
        return every.select(self.key, F.round(score, 6).alias("rank")).orderBy("rank", self.key).limit(clamp_limit(limit))

    def search(self, events: DataFrame, query: str, text: str, *, where: Column | None = None, limit: int = 20) -> DataFrame:
        """The events that a keyword search finds, as ``search.search_events``, by the index; only their rows' texts are read."""
        hits = self.bm25(query, limit=limit, among=None if where is None else events.where(where))
        # at most ``limit`` hits
        return events.join(F.broadcast(hits), self.key).withColumn("snippet", search.snippet(F.col(text), query)).orderBy("rank", self.key)
