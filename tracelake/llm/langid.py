"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is
parsed greedily into the longest phrases that occur in the sample, the longest match running on
until the automaton has no move. Few phrases mean that the text looks like the sample: the language
with the fewest phrases per character, in bits of a pointer into its sample, wins.

Texts are normalised to lower-case letters and single spaces and cut into segments of ``SEGMENT``
symbols, each parsed on its own, so a text of any length takes a bounded number of numpy steps:
one step moves every segment of many texts through all automata at once. Whole texts are parsed. The letters of all samples are
symbols: the most frequent ones one symbol each, the others a lead symbol and two or three more, so scripts of any size are told apart.

Defined cases: null texts and texts without a letter give ``und`` and score 0. Ties go to the first
language in code-point order. Rows without a language teach nothing; without any labelled text every
text is ``und``. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import freeing, passes, table

#: Symbols of labelled text that a language learns from, and the documents they come from, at most.
SAMPLE_SYMBOLS = 40_000
SAMPLE_DOCS = 150
SEGMENT = 512
#: Symbols: 0 is a letter that no sample has, 1 the space, 2 to 61 the most frequent letters of the samples or, after a
#: lead symbol, digits; 62 leads two digits, 63 three.
ALPHABET = 64
DIGITS = ALPHABET - 4
UNKNOWN = "und"


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def lowered(c: str) -> str:
    """One letter in lower case, itself where that would be several characters."""
    low = c.lower()
    return low if len(low) == 1 else c


class Automaton:
    """Suffix automaton of one symbol string, with a dense move table (-1: no move)."""

    def __init__(self, symbols: list[int], width: int):
        go: list[dict[int, int]] = [{}]
        link, depth, last = [-1], [0], 0
        for c in symbols:
            fresh, p = len(go), last
            go.append({})
            depth.append(depth[last] + 1)
            link.append(0)
            while p >= 0 and c not in go[p]:
                go[p][c] = fresh
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if depth[q] == depth[p] + 1:
                    link[fresh] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    depth.append(depth[p] + 1)
                    link.append(link[q])
                    link[q] = link[fresh] = twin
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
            last = fresh
        self.moves = np.full((len(go), width), -1, np.int32)
        for s, out in enumerate(go):
            for c, t in out.items():
                self.moves[s, c] = t


class LanguageModel:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        counts: dict[str, int] = {}
        for text in samples.values():
            for c in text:
                if c.isalpha():
                    counts[lowered(c)] = counts.get(lowered(c), 0) + 1
        letters = {c: k for k, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
        self.code = np.ones(0x110000, np.uint8)
        self.rank = np.zeros(0x110000, np.int32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                k = letters.get(lowered(c), -1)
                self.code[point] = k + 2 if k < DIGITS else ALPHABET - 2 if k < DIGITS + DIGITS**2 else ALPHABET - 1
                self.rank[point] = max(0, k - DIGITS)
        self.width = len(letters) + 2 if len(letters) <= DIGITS else ALPHABET
        sizes, self.moves, self.roots = [], np.zeros(0, np.int32), []
        for lang in self.languages:
            symbols = self.symbols([samples[lang]])[0].tolist()[:SAMPLE_SYMBOLS]
            moves = Automaton(symbols, self.width).moves
            self.roots.append(len(self.moves) // self.width)
            self.moves = np.concatenate([self.moves, np.where(moves >= 0, moves + self.roots[-1], -1).astype(np.int32).ravel()])
            sizes.append(max(2, len(symbols)))
        self.cost = np.log2(np.array(sizes, np.float64)) if sizes else np.zeros(0)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, and how many each has: letters, one space wherever anything else stands between letters."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.code[points]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), sizes)
        letter = np.flatnonzero(codes != 1)
        fresh = np.ones(len(letter), bool)
        fresh[1:] = owner[letter[1:]] != owner[letter[:-1]]
        gap = ~fresh
        gap[1:] &= np.diff(letter) > 1
        place = np.arange(len(letter)) + np.cumsum(gap)
        out = np.ones(len(letter) + int(gap.sum()), np.uint8)
        out[place] = codes[letter]
        many = np.flatnonzero(out >= ALPHABET - 2)
        sizes = np.bincount(owner[letter], minlength=len(texts)) + np.bincount(owner[letter[gap]], minlength=len(texts))
        if len(many):
            width = np.ones(len(out), np.int64)
            width[many] = out[many] - (ALPHABET - 2) + 3
            which = letter[np.searchsorted(place, many)]
            rest = self.rank[points[which]] - np.where(width[many] == 4, DIGITS**2, 0)
            sizes += np.bincount(owner[which], weights=width[many] - 1, minlength=len(texts)).astype(sizes.dtype)
            at = (np.cumsum(width) - width)[many]
            out = np.repeat(out, width)
            for k in (3, 2, 1):
                has = width[many] > k
                out[at[has] + k] = rest[has] % DIGITS + 2
                rest = np.where(has, rest // DIGITS, rest)
        return out, sizes

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts [text, language] and the number of symbols of each text."""
        flat, sizes = self.symbols(texts)
        flat = np.concatenate([flat, np.zeros(SEGMENT, np.uint8)]).astype(np.int32)
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        alive = len(size) - np.searchsorted(size[::-1], np.arange(SEGMENT), side="right")
        count = np.zeros((len(self.roots), len(size)), np.int32)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(size), axis=1)
        for step in range(SEGMENT):
            n = int(alive[step])
            if not n:
                break
            symbol = flat[start[:n] + step]
            for k, root in enumerate(self.roots):
                now = state[k, :n]
                to = self.moves[now * self.width + symbol]
                begins = np.flatnonzero((to < 0) | (now == root))
                count[k, begins] += 1
                again = self.moves[root * self.width + symbol[begins]]
                # a symbol that the sample lacks is a phrase of its own and leaves the automaton at its root
                to[begins] = np.where(again < 0, root, again)
                state[k, :n] = to
        return np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in count], axis=1).astype(np.int64), sizes


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Sample text by language, from documents that are not held out: a window of each of about ``SAMPLE_DOCS`` documents a language, those with the
    smallest id hashes, at a place of the whole text that a hash chooses. An id counts once."""
    labelled = docs.where(~is_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rank = F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 62) - 1))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).count().collect()}  # one row a language
    if not counts:
        return {}
    # of n evenly spread hashes about SAMPLE_DOCS lie below this share of their range
    chosen, size = F.lit(False), F.lit(0)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col(lang_col) == lang) & (rank <= int(min(1.0, SAMPLE_DOCS / n) * ((1 << 62) - 1))))
        size = F.when(F.col(lang_col) == lang, 2 * SAMPLE_SYMBOLS // min(n, SAMPLE_DOCS)).otherwise(size)
    at = F.pmod(F.xxhash64(F.lit(1), "rank"), F.greatest(F.lit(1), F.length("text") - F.col("size") + 1))
    rows = labelled.where(chosen).select(F.col(lang_col).alias("lang"), rank.alias("rank"), size.alias("size"), F.col(text_col).alias("text"))
    windows = rows.select("lang", "rank", F.substring("text", (at + 1).cast("int"), F.col("size")).alias("text")).groupBy("lang", "rank").agg(F.min("text").alias("text")).toPandas()
    out = {}
    for lang, part in windows.groupby("lang"):
        text = " ".join(part.sort_values("rank").text)
        if any(c.isalpha() for c in text):
            out[str(lang)] = text
    return out


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and score of every text: the score is the winner's share when each language weighs 2 to the minus its bits per symbol, times eight."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in passes(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if m.languages:
                    counts, sizes = m.phrases(texts)
                    bits = counts * m.cost / np.maximum(1, sizes)[:, None]
                    best = np.argmin(bits, axis=1)
                    weight = np.exp2(-8 * (bits - bits.min(axis=1, keepdims=True)))
                    sure = 1 / weight.sum(axis=1)
                    for k in np.flatnonzero(sizes).tolist():
                        langs[k], scores[k] = m.languages[best[k]], float(sure[k])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freeing(run), "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, LanguageModel(sample(docs)))
