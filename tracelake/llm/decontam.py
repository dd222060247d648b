"""Benchmark decontamination by a generalised suffix automaton over test items.

The items are normalised to words and built into a generalised suffix automaton; every training
document is streamed through it, so that at each word the longest match with any item is known.
Matches that reach the window length are contaminated spans. Spans are cut, and documents whose
coverage reaches the limit are dropped.

Words: A-Z lower-cased, then runs of ``0-9 a-z`` and all characters beyond ASCII. A window is
``window`` consecutive words of an item; an item with fewer words, but not none, is one window.

Defined cases: null or empty texts have no words, no hits and are kept. Items without words match
nothing. Repeated items each report their own id. Repeated document rows give one result row each.
Extra columns are ignored by ``find_contamination`` and kept by ``remove_contamination``. An empty
benchmark contaminates nothing; an empty document table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import freeing, passes, sifted, table, written

WINDOW = 13
#: Share of a document's words, as one over this number, from which the whole document goes.
COVERAGE = 20
#: Words of items in one automaton, about 60 MB in a worker. More items make more automata, one pass over the documents each.
BLOCK_WORDS = 100_000

#: Lower-cases A-Z; every other ASCII byte that is no digit or letter separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in a text that is not lower-cased yet.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: A hit: words [start, end) of a document, at its characters [first, last).
_HIT = "struct<start:long,end:long,first:long,last:long>"
_FOUND = (pa.field("n_words", pa.int64()), pa.field("longest", pa.int64()), pa.field("items", pa.list_(pa.string())), pa.field("hits", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "first", "last")]))))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over the words of many items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.depth = [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min((min(len(c), window) for _, c in coded), default=0)
        self.owners: dict[int, set[str]] = {}
        shorts: dict[int, list[tuple[int, str]]] = {}
        for item, codes in coded:
            state = 0
            for i, c in enumerate(codes):
                state = self.go[state][c]
                if i + 1 >= window:
                    self.owners.setdefault(self._shortened(state), set()).add(item)
            if len(codes) < window:
                shorts.setdefault(state, []).append((len(codes), item))
        self.whole: dict[int, tuple[tuple[int, str], ...]] = {}
        if shorts:
            for state in sorted(range(1, len(self.go)), key=self.depth.__getitem__):
                found = tuple(shorts.get(state, ())) + self.whole.get(self.link[state], ())
                if found:
                    self.whole[state] = found

    def _new(self, depth: int, link: int, go: dict[int, int]) -> int:
        self.go.append(go)
        self.link.append(link)
        self.depth.append(depth)
        return len(self.go) - 1

    def _split(self, p: int, c: int) -> int:
        """The state below p by c whose longest word has exactly one more word than p's."""
        q = self.go[p][c]
        if self.depth[q] == self.depth[p] + 1:
            return q
        twin = self._new(self.depth[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = twin
        while p != -1 and self.go[p].get(c) == q:
            self.go[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.go[last]:
            return self._split(last, c)
        fresh = self._new(self.depth[last] + 1, 0, {})
        p = last
        while p != -1 and c not in self.go[p]:
            self.go[p][c] = fresh
            p = self.link[p]
        self.link[fresh] = 0 if p == -1 else self._split(p, c)
        return fresh

    def _shortened(self, state: int) -> int:
        """The state of the last ``window`` words of a match in ``state``."""
        while self.depth[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit word spans (end exclusive, merged), items with a window inside, longest match. -1 codes a word no item has."""
        known = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        hits: list[list[int]] = []
        items: set[str] = set()
        longest = 0
        go, link, depth, window, whole = self.go, self.link, self.depth, self.window, self.whole
        for start, stop in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if not 0 < self.shortest <= stop - start:
                continue
            state = length = 0
            for i, c in enumerate(codes[start:stop].tolist(), start):
                while state and c not in go[state]:
                    state = link[state]
                    length = depth[state]
                if c not in go[state]:
                    continue
                state = go[state][c]
                length += 1
                longest = max(longest, length)
                reach = 0
                if length >= window:
                    reach = window
                    items |= self.owners[self._shortened(state)]
                if whole and state in whole:
                    for n, item in whole[state]:
                        if n <= length:
                            reach = max(reach, n)
                            items.add(item)
                if reach:
                    begin = i + 1 - reach
                    while hits and hits[-1][0] >= begin:
                        hits.pop()
                    if hits and hits[-1][1] >= begin:
                        hits[-1][1] = i + 1
                    else:
                        hits.append([begin, i + 1])
        return [(a, b) for a, b in hits], items, longest


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS, *, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The items with an id and a text, in blocks of about ``block_words`` words or one item, by a hash of each item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (4 * block_words)))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def _sent(block: DataFrame, window: int) -> Broadcast:
    """The automaton of one block, sent to the tasks; its size is bounded by the block's."""
    return block.sparkSession.sparkContext.broadcast(ItemAutomaton([(r.item_id, words_of(r.text)) for r in block.toLocalIterator()], window))


def _matched(automaton: ItemAutomaton, text: str | None) -> dict:
    """What one document has of one block: hit spans in words with their places in characters, items, longest match."""
    words = words_of(text)
    lookup = automaton.vocabulary.get
    hits, items, longest = automaton.scan(np.fromiter((lookup(w, -1) for w in words), np.int32, len(words)))
    at = [m.span() for m in _WORD.finditer(text)] if hits else []
    spans = [{"start": a, "end": b, "first": at[a][0], "last": at[b - 1][1]} for a, b in hits]
    return {"n_words": len(words), "longest": longest, "items": sorted(items), "hits": spans}


def _scanned(texts: DataFrame, shared: Broadcast, key: str, every: bool) -> DataFrame:
    """(key, n_words, longest, items, hits) of (key, text) rows against one automaton; with ``every`` false, only of rows that share a word with it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in (part for whole in batches for part in passes(whole, "text")):
            rows = [{"key": k, **_matched(automaton, text)} for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([r for r in rows if every or r["longest"]], pa.schema([pa.field("key", batch.schema.field(0).type), *_FOUND]))

    return texts.mapInArrow(freeing(scan), f"key {key}, n_words long, longest long, items array<string>, hits array<{_HIT}>")


def _merged_hits(hits: Column) -> Column:
    """Sorted hits with those that meet or overlap made one."""
    last = lambda done: F.element_at(done, -1)
    joined = lambda one, h: F.struct(one["start"].alias("start"), F.greatest(one["end"], h["end"]).alias("end"), one["first"].alias("first"), F.greatest(one["last"], h["last"]).alias("last"))
    step = lambda done, h: F.when((F.size(done) > 0) & (h["start"] <= F.get(done, F.size(done) - 1)["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined(last(done), h)))).otherwise(F.concat(done, F.array(h)))
    return F.aggregate(F.array_sort(hits), F.array().cast(f"array<{_HIT}>"), step)


def text_key(text: str) -> Column:
    """Equal for equal texts; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _scanned_texts(docs: DataFrame, blocks: list[DataFrame], window: int, text_col: str) -> DataFrame:
    """One row for each distinct text: one pass over the documents a block, each with only its own automaton, written before the next; a pass keeps small rows, no texts."""
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    found = None
    for k, block in enumerate(blocks):
        shared = _sent(block, window)
        one = written(_scanned(texts, shared, "string", k == 0), "scan")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    flat = lambda c: F.flatten(F.collect_set(c))
    return found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.max("longest").alias("longest"), F.array_sort(F.array_distinct(flat("items"))).alias("items"), _merged_hits(flat("hits")).alias("hits"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word and hit counts, items found, hit spans in words and in characters."""
    blocks = blocks_of(benchmark, block_words)
    ids = F.col(id_col).cast("long")
    if len(blocks) == 1:
        found = _scanned(docs.select(ids.alias("doc_id"), F.col(text_col).alias("text")), _sent(blocks[0], window), "long", True).withColumnRenamed("key", "doc_id")
    else:
        keyed = docs.select(ids.alias("doc_id"), text_key(text_col).alias("key"))
        found = keyed.join(_scanned_texts(docs, blocks, window, text_col), "key")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    pairs = lambda a, b: F.transform("hits", lambda h: F.struct(h[a].alias("start"), h[b].alias("end")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "longest", "items", pairs("start", "end").alias("spans"), pairs("first", "last").alias("char_spans"))


def is_contaminated(coverage: int = COVERAGE):
    """The rule: any hit, and at least one word in ``coverage`` hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))


def _without(text: Column, hits: Column) -> Column:
    """``text`` without the characters of its sorted, merged hits."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(hits, lambda h: h["last"]))
    ends = F.concat(F.transform(hits, lambda h: h["first"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(kept, "")


def _removed_in_passes(docs: DataFrame, blocks: list[DataFrame], window: int, coverage: int) -> DataFrame:
    """The same for a benchmark of several blocks; only documents that may have hits are shuffled."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    hit = written(_scanned_texts(docs, blocks, window, "text").where("size(hits) > 0").select("key", "n_words", "hits"), "hits")
    both = sifted(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), text_key("text").alias("key")), hit, "key")
    maybe = both.where("maybe").join(hit, "key", "left").where(F.col("hits").isNull() | (n_hit * coverage < F.col("n_words")))
    cut = F.when(F.col("hits").isNull(), F.col("doc.text")).otherwise(_without(F.col("doc.text"), F.col("hits")))
    new = {"text": cut}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hits").isNull(), F.col("doc.n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    whole = lambda changes: [changes.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]
    return both.where("not maybe").select(*whole({})).unionByName(maybe.select(*whole(new)))


def _cut(automaton: ItemAutomaton, batches: Iterator[pa.RecordBatch], text_at: int, count_at: int | None, coverage: int) -> Iterator[pa.RecordBatch]:
    """The batches without contaminated documents and hit spans, a pass of texts at a time: a batch may hold a whole task's texts, and is not repeated as Python strings."""
    for batch in (part for whole in batches for part in passes(whole, text_at)):
        keep, texts, changed = [], batch.column(text_at).to_pylist(), {}
        for i, text in enumerate(texts):
            found = _matched(automaton, text)
            spans = found["hits"]
            n_hit = sum(h["end"] - h["start"] for h in spans)
            if n_hit and coverage * n_hit >= found["n_words"]:
                continue
            keep.append(i)
            if spans:
                edges = [0, *(x for h in spans for x in (h["first"], h["last"])), len(text)]
                changed[i] = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        if changed:
            columns = list(batch.columns)
            columns[text_at] = pa.array([changed.get(i, text) for i, text in enumerate(texts)], columns[text_at].type)
            if count_at is not None:
                counts = columns[count_at].to_pylist()
                for i, text in changed.items():
                    counts[i] = len(text)
                columns[count_at] = pa.array(counts, columns[count_at].type)
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int32()))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without contaminated ones; what remains has its hit spans cut. Keeps all columns; ``n_chars`` follows the text."""
    blocks = blocks_of(benchmark, block_words)
    if len(blocks) > 1:
        return _removed_in_passes(docs, blocks, window, coverage)
    shared = _sent(blocks[0], window)
    text_at = docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(shared.value, batches, text_at, count_at, coverage)

    return docs.mapInArrow(freeing(cut), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of op1, from ``find_contamination``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
