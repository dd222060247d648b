"""Keyword and vector search over texts: chunks, postings, BM25, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.filters import clamp_limit

CHUNK_MOST, CHUNK_LEAST = 1200, 100
K1, B = 1.2, 0.75
EMBED_CHARS, EMBED_SIZE = 1500, 768
#: Texts that an embedder gets at once; their vectors stay numpy arrays.
EMBED_ROWS = 256


def tokens(text: Column) -> Column:
    """Lower-case word tokens, the accents of Latin-1 letters dropped."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def chunks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, offset, chunk): paragraphs packed up to ``CHUNK_MOST`` characters; a chunk below ``CHUNK_LEAST`` joins the one before."""
    pieces = F.transform(F.split(F.col(text), "\n\n"), F.trim)

    def pack(state: Column, para: Column) -> Column:
        here, done = state["here"], state["done"]
        at = state["at"]
        fits = (here["chunk"] == "") | (F.length(here["chunk"]) + F.length(para) + 2 <= CHUNK_MOST)
        grown = F.when(here["chunk"] == "", F.struct(at.alias("offset"), para.alias("chunk"))).otherwise(F.struct(here["offset"].alias("offset"), F.concat_ws("\n\n", here["chunk"], para).alias("chunk")))
        closed = F.when(fits | (F.length(here["chunk"]) < CHUNK_LEAST), done).otherwise(F.concat(done, F.array(here)))
        moved = F.struct((at + F.length(para) + 2).alias("at"), F.when(fits, grown).otherwise(F.struct(at.alias("offset"), para.alias("chunk"))).alias("here"), closed.alias("done"))
        return F.when(para == "", F.struct((at + 2).alias("at"), here.alias("here"), done.alias("done"))).otherwise(moved)

    empty = F.struct(F.lit(0).alias("at"), F.struct(F.lit(0).alias("offset"), F.lit("").alias("chunk")).alias("here"), F.array().cast("array<struct<offset:int,chunk:string>>").alias("done"))

    def finish(state: Column) -> Column:
        here, done = state["here"], state["done"]
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["offset"].alias("offset"), F.concat_ws("\n\n", last["chunk"], here["chunk"]).alias("chunk"))))
        return F.when(here["chunk"] == "", done).when((F.length(here["chunk"]) >= CHUNK_LEAST) | (F.size(done) == 0), F.concat(done, F.array(here))).otherwise(joined)

    packed = F.when(F.length(text) < CHUNK_LEAST, F.array(F.struct(F.lit(0).alias("offset"), F.col(text).alias("chunk")))).otherwise(F.aggregate(pieces, empty, pack, finish))
    rows = texts.where(F.coalesce(F.col(text), F.lit("")) != "")
    return rows.select(key, F.posexplode(packed).alias("nth", "c")).select(key, "nth", F.col("c.offset").alias("offset"), F.col("c.chunk").alias("chunk"))


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): the inverted index."""
    words = texts.select(key, tokens(F.col(text)).alias("words"))
    return words.select(key, F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(texts: DataFrame, query: str, key: str, text: str, *, limit: int = 20, where: Column | None = None) -> DataFrame:
    """The texts that have every word of the query, best first; as in full-text indexes a lower rank is better.

    ``where`` picks among all texts before the limit; lengths and frequencies are those of all. Only terms of the query leave the scan: each text is one row of its length and its counts of those terms.
    """
    terms = sorted(set(query.lower().split()))
    schema = f"{key} {dict(texts.dtypes)[key]}, rank double"
    if not terms:
        return texts.sparkSession.createDataFrame([], schema)
    words = texts.select(key, tokens(F.col(text)).alias("words"), (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("wanted"))
    counts = words.select(key, "wanted", F.size("words").alias("length"), *(_occurrences(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = counts.agg(F.count(F.lit(1)).alias("n_texts"), F.avg("length").alias("mean_length"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score = bm25_score(stats["n_texts"], stats["mean_length"], [stats[f"df{i}"] for i in range(len(terms))])
    every = counts.where("wanted AND " + " AND ".join(f"tf{i} > 0" for i in range(len(terms))))
    return every.select(key, F.round(score, 6).alias("rank")).orderBy("rank", key).limit(clamp_limit(limit))


def bm25_score(n: int, mean_length: float | None, document_frequencies: list[int]) -> Column:
    """The rank of a row with its ``length`` and its counts ``tf0``, ``tf1``, ... of the query's terms."""
    score = F.lit(0.0)
    for i, df in enumerate(document_frequencies):
        idf = max(1e-6, float(np.log((n - df + 0.5) / (df + 0.5))))
        tf = F.col(f"tf{i}")
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / (mean_length or 1.0)))
    return score


def _occurrences(term: str) -> Column:
    return F.size(F.filter("words", lambda w: w == term))


def snippet(text: Column, query: str, words: int = 32) -> Column:
    """About ``words`` words around the first match, matches marked."""
    terms = [t for t in query.split() if t]
    any_term = "(?i)\\b(" + "|".join(f"\\Q{t}\\E" for t in terms) + ")\\b"
    window = F.regexp_extract(text, f"(?is)(?:\\S+\\s+){{0,{words // 2}}}\\S*\\b(?:{'|'.join(f'\\Q{t}\\E' for t in terms)})\\b(?:\\s+\\S+){{0,{words // 2}}}", 0)
    return F.regexp_replace(window, any_term, "<mark>$1</mark>")


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: list[float], key: str, vector: str, *, limit: int = 20, where: Column | None = None) -> DataFrame:
    """The exactly nearest vectors by cosine distance; filters come before the limit."""
    rows = vectors if where is None else vectors.where(where)
    distance = F.round(cosine_distance(F.col(vector), F.lit(query)), 6)
    return rows.select(key, distance.alias("distance")).orderBy("distance", key).limit(clamp_limit(limit))


def search_events(events: DataFrame, query: str, key: str, text: str, *, mode: str = "keyword", where: Column | None = None, limit: int = 20, embedder=None) -> DataFrame:
    """The events that a search finds, best first: all their columns with ``rank`` and a marked ``snippet``, or for mode ``semantic`` with
    the ``distance`` of their nearest chunk and that ``chunk``. Any other mode is keyword search; filters come before the limit."""
    if mode != "semantic":
        # at most ``limit`` hits
        hits = bm25(events, query, key, text, limit=limit, where=where)
        return events.join(F.broadcast(hits), key).withColumn("snippet", snippet(F.col(text), query)).orderBy("rank", key)
    embedder = embedder or hashing_embedder
    rows = events if where is None else events.where(where)
    pieces = chunks(rows, key, text).withColumn("piece", F.concat_ws("#", F.col(key).cast("string"), "nth"))
    vectors = embed(pieces, "piece", "chunk", embedder).join(pieces, "piece")
    distance = F.round(cosine_distance(F.col("embedding"), F.lit([float(x) for x in embedder([query])[0]])), 6)
    best = vectors.withColumn("distance", distance).where(~F.isnan("distance")).groupBy(key).agg(F.min(F.struct("distance", "nth", "chunk")).alias("best"))
    hits = best.select(key, "best.distance", "best.chunk").orderBy("distance", key).limit(clamp_limit(limit))
    return events.join(F.broadcast(hits), key).orderBy("distance", key)


def mean_pooled(vectors: Column) -> Column:
    """The mean of an array of vectors, scaled to length 1; null for none."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors), F.lit(1))), F.element_at(vectors, 1), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: F.try_divide(x.cast("double"), norm)))


def hashing_embedder(texts: list[str | None], size: int = EMBED_SIZE) -> list[np.ndarray]:
    """The offline stand-in for an embedding model: signed hashed words and word pairs, normalised."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(size, np.float32)
        words = (t or "")[:EMBED_CHARS].lower().split()
        for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            h = zlib.crc32(w.encode())
            v[h % size] += 1 if h >> 31 else -1
        out.append(v / (np.linalg.norm(v) or 1))
    return out


def letter_embedder(texts: list[str | None], size: int = 256) -> list[np.ndarray]:
    """The offline stand-in for an embedding of short names: hashed runs of three letters, the ends marked, normalised."""
    import zlib

    out = []
    for t in texts:
        v, padded = np.zeros(size, np.float32), f"  {t or ''} "
        for k in range(len(padded) - 2):
            h = zlib.crc32(padded[k : k + 3].encode())
            v[h % size] += 1 if h >> 31 else -1
        out.append(v / (np.linalg.norm(v) or 1))
    return out


def embed(texts: DataFrame, key: str, text: str, embedder=hashing_embedder) -> DataFrame:
    """(key, embedding) by a pluggable embedder, ``EMBED_ROWS`` texts at a time."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, EMBED_ROWS):
                part = batch.slice(low, EMBED_ROWS)
                found = [np.asarray(v, np.float32) for v in embedder(part.column(1).to_pylist())]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], [key, "embedding"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")
