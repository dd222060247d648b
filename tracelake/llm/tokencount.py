"""Exact token counts at every prefix of a text, by dynamic programming, kept for truncation and budget questions.

Byte-pair encoding has a prefix property: the encoding of a piece without its last token is the encoding of what is left,
and a row of tokens is an encoding if and only if each token and its successor are one. So for each prefix of a piece exactly
one vocabulary token can be its last: ``count[i] = count[i - len(t)] + 1`` for the one token ``t`` that ends at ``i`` and goes
with the last token of the prefix before it. A pair goes together if, as the merges run by rank inside each of the two, none
over their border comes first.

A text is cut into *units* that don't depend on what stands around them: white space with the run of letters, digits or other
signs (or the contraction) behind it. In a prefix that ends in white space all of the white space is one piece; once a sign
follows, its last symbol is split off. Both are worked out in the unit, so the counts of a text are those of its units, one
after the other; each worker keeps a bounded table of units. The vocabulary's special string is one token wherever it stands
whole, as in the library; a prefix that ends inside it holds ordinary text.

The store has one row per document with blocks of steps (the change of the count at each character) and each block's first,
least and greatest count, so that a question reads one block of a document and no text is encoded again.

Defined cases: a null or empty text has no characters, no tokens and no blocks. Repeated rows and null ids are rows like all
others. An empty table gives an empty store. Columns of other names are ignored. The count may fall from one prefix to the next
one, as signs merge; "within a budget" means the longest prefix whose count does not exceed it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracelake.llm.common import freeing, passes, table, written

#: Tokens beyond which op11 reports a document.
LIMIT = 1024
#: Characters of a block of the store.
BLOCK_CHARS = 4096
#: Units, and token pairs, that a worker keeps; a table starts anew beyond it.
KEPT = 700_000

_SPACE = r"\p{White_Space}"
#: Letters and digits that the tokenizers library does not know yet and reads as other signs.
_NEW = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
_UNITS = regex.compile(rf"{_SPACE}*+(?:(?<! )'(?:[sdmt]|re|ve|ll)|(?:(?![{_NEW}])\p{{L}})+|(?:(?![{_NEW}])\p{{N}})+|(?:[{_NEW}]|[^{_SPACE}\p{{L}}\p{{N}}])+)|{_SPACE}+")
_CONTRACTION = regex.compile(r"'(?:[sdmt]|re|ve|ll)")
_LEAD = regex.compile(rf"{_SPACE}*")

STORE_SCHEMA = "doc_id long, n_bytes long, n_chars long, n_tokens long, blocks array<struct<first:long,before:long,least:long,most:long,steps:binary>>"
_BLOCK = pa.struct([("first", pa.int64()), ("before", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("steps", pa.binary())])
_STORE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("blocks", pa.list_(_BLOCK))])


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _words(text: str) -> list[str]:
    """A text cut before its spaces, which are left out, and newlines, which are kept."""
    return text.replace("\n", " \n").split(" ")


class PrefixCounter:
    """Counts the tokens of every prefix of texts, for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, kept: int = KEPT):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, split, model = spec["pre_tokenizer"] or {}, spec["normalizer"], spec["model"]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or split or model.get("type") != "BPE" or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        octets = lambda word: bytes(letters[c] for c in word)
        self.special = [t["content"] for t in spec["added_tokens"]]
        if len(self.special) > 1 or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("one plain special string at most")
        self.tokens = {octets(w) for w in model["vocab"] if w not in set(self.special)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(octets(a), octets(b)): k for k, (a, b) in enumerate(pairs)}
        self.made = {a + b: (len(a), k) for (a, b), k in self.rank.items()}
        if len(self.made) != len(self.rank) or self.made.keys() | {bytes([k]) for k in range(256)} != self.tokens:
            raise ValueError("each token must be a byte or come from one merge")
        self.tails = {t[k:] for t in self.tokens for k in range(len(t))}
        self.longest = max(map(len, self.tokens))
        self.kept, self.units, self.words, self.pairs, self.edges = kept, {}, {}, {}, ({}, {})
        self.state: tuple[bytes, list[bytes], list[int]] = b"", [b""], [0]

    def _edges(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The tokens that stand at one edge of a token while the merges make it, from its byte up, each with the rank that takes it up."""
        found = self.edges[right].get(token)
        if found is None:
            found, taken = [], 1 << 60
            at = token
            while True:
                found.append((at, taken))
                if len(at) == 1:
                    break
                size, taken = self.made[at]
                at = at[size:] if right else at[:size]
            found = self.edges[right][token] = found[::-1]
        return found

    def together(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens are the encoding of their bytes: no merge over their border comes before the merges that take up its sides."""
        known = self.pairs.get((a, b))
        if known is None:
            left, right, rank = self._edges(a, True), self._edges(b, False), self.rank
            i = j = 0
            known = True
            while True:
                (x, x_taken), (y, y_taken) = left[i], right[j]
                over = rank.get((x, y), 1 << 61)
                # of merges of one rank the one further left comes first
                if over < x_taken and over <= y_taken:
                    known = False
                    break
                if x_taken == y_taken == 1 << 60:
                    break
                if x_taken <= y_taken:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= self.kept:
                self.pairs = {}
            self.pairs[a, b] = known
        return known

    def piece(self, raw: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... bytes of one piece; what it shares with the piece before it is taken over."""
        tokens, tails, together = self.tokens, self.tails, self.together
        former, last, count = self.state
        same = next((k for k, (a, b) in enumerate(zip(raw, former, strict=False)) if a != b), min(len(raw), len(former)))
        del last[same + 1 :], count[same + 1 :]
        for end in range(same + 1, len(raw) + 1):
            if end <= self.longest and raw[:end] in tokens:
                last.append(raw[:end])
                count.append(1)
                continue
            start = end - 1
            while start > 0 and raw[start - 1 : end] in tails:
                start -= 1
            while raw[start:end] not in tokens or not together(last[start], raw[start:end]):
                start += 1
            last.append(raw[start:end])
            count.append(count[start] + 1)
        self.state = raw, last, count
        return count[:]

    def chars(self, piece: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... characters of one piece."""
        if not piece:
            return []
        count = self.piece(piece.encode())
        return count[1:] if piece.isascii() else [count[k] for k in accumulate(len(c.encode()) for c in piece)]

    def unit(self, unit: str) -> bytes:
        """The steps of a unit as little-endian 16-bit numbers."""
        if unit[0] == " " and len(unit) > 1 and not unit[1].isspace():
            counts = self.chars(unit)
        else:
            lead = _LEAD.match(unit)[0]
            body, counts = unit[len(lead) :], self.chars(lead)
            spaced = lead.endswith(" ")
            if not body:
                inner = []
            elif spaced:
                inner = self.chars(" " + body)[1:]
            elif _CONTRACTION.fullmatch(body):
                inner = [*self.chars("'"), *(1 + n for n in self.chars(body[1:-1])), self.chars(body)[-1]]
            else:
                inner = self.chars(body)
            before = sum(self.chars(a)[-1] for a in ([lead[:-1]] if spaced else [lead[:-1], lead[-1:]]) if a)
            counts += [before + n for n in inner]
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def ordinary(self, text: str) -> bytes:
        """The steps of a text without special strings, unit by unit."""
        known, out = self.units, []
        for u in _UNITS.findall(text):
            steps = known.get(u)
            if steps is None:
                steps = self.unit(u)
                if len(known) >= self.kept:
                    known = self.units = {}
                if len(u) <= 64:
                    known[u] = steps
            out.append(steps)
        return b"".join(out)

    def learn(self, texts: list[str | None]) -> None:
        """Take the new words of some texts into the table, in order, as neighbours share their first letters."""
        new = sorted(set().union(*(_words(t)[1:] for t in texts if t)) - self.words.keys())
        if len(self.words) + len(new) > self.kept:
            self.words = {}
            new = sorted(set().union(*(_words(t)[1:] for t in texts if t)))
        for w in new:
            # a word that white space ends, or none at all, stands in longer white space, which is no word's own
            if w and len(w) <= 64 and not w[-1].isspace():
                self.words[w] = self.unit(" " + w) if w.isascii() and w.isalpha() else self.ordinary(w if w[0] == "\n" else " " + w)

    def plain(self, text: str) -> bytes:
        """The steps of a text without special strings: of its known words, or else unit by unit."""
        first, *rest = _words(text)
        if first and not first[-1].isspace():
            try:
                return b"".join([self.ordinary(first), *map(self.words.__getitem__, rest)])
            except KeyError:
                pass
        return self.ordinary(text)

    def steps(self, text: str) -> np.ndarray:
        """The change of the token count at each character of a text."""
        if not self.special or self.special[0] not in text:
            return np.frombuffer(self.plain(text), "<i2")
        mark, out = self.special[0], []
        *closed, rest = text.split(mark)
        for part in closed:
            # up to its last sign the special string is ordinary text, and then one token instead
            run = np.frombuffer(self.ordinary(part + mark[:-1]), "<i2").astype(np.int64)
            whole = run[: len(part)].sum() + 1
            out += [run, [whole - run.sum()]]
        out.append(np.frombuffer(self.plain(rest), "<i2"))
        return np.concatenate(out).astype("<i2")


@lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _blocks(steps: np.ndarray, block_chars: int) -> list[dict]:
    out, before = [], 0
    for first in range(0, len(steps), block_chars):
        part = steps[first : first + block_chars]
        counts = before + np.cumsum(part, dtype=np.int64)
        out.append({"first": first, "before": before, "least": int(counts.min()), "most": int(counts.max()), "steps": part.tobytes()})
        before = int(counts[-1])
    return out


def store_counts(docs: DataFrame, *, tokenizer: str | None = None, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the counts of every prefix of every document; the store, read back."""
    path = tokenizer or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in passes(batch, "text"):
                rows, texts = [], part.column(1).to_pylist()
                counter.learn(texts)
                for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    steps = counter.steps(text or "")
                    blocks = _blocks(steps, block_chars)
                    rows.append({"doc_id": doc_id, "n_bytes": len((text or "").encode()), "n_chars": len(steps), "n_tokens": int(steps.sum(dtype=np.int64)), "blocks": blocks})
                yield pa.RecordBatch.from_pylist(rows, _STORE)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(freeing(count), STORE_SCHEMA), "token-counts")


@F.udf(LongType(), useArrow=True)
def _count_in(before: int | None, steps: bytes | None, n: int | None) -> int | None:
    return None if steps is None else before + int(np.frombuffer(steps, "<i2")[:n].sum(dtype=np.int64))


@F.udf(LongType(), useArrow=True)
def _last_within(before: int | None, steps: bytes | None, budget: int | None) -> int | None:
    return None if steps is None else int(np.flatnonzero(before + np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64) <= budget)[-1]) + 1


def tokens_at(store: DataFrame, chars: Column, name: str = "tokens") -> DataFrame:
    """The store's rows with the token count of the prefix of ``chars`` characters (the whole text if it has fewer); one block is read."""
    n = F.greatest(F.least(chars.cast("long"), F.col("n_chars")), F.lit(0))
    block = F.element_at(F.filter("blocks", lambda b: b["first"] < n), -1)
    rows = store.withColumn("asked_n", n).withColumn("asked_block", F.when(F.col("asked_n") > 0, block))
    inner = _count_in(F.col("asked_block.before"), F.col("asked_block.steps"), F.col("asked_n") - F.col("asked_block.first"))
    return rows.withColumn(name, F.when(F.col("asked_n") == 0, F.lit(0).cast("long")).otherwise(inner)).drop("asked_n", "asked_block")


def longest_within(store: DataFrame, budget: Column, name: str = "kept_chars") -> DataFrame:
    """The store's rows with the characters of the longest prefix of at most ``budget`` tokens; the last block that reaches down to it is read."""
    most = budget.cast("long")
    block = F.element_at(F.filter("blocks", lambda b: b["least"] <= most), -1)
    # only a text that doesn't fit as a whole has a block looked into
    rows = store.withColumn("asked_block", F.when((F.col("n_tokens") > most) & F.exists("blocks", lambda b: b["least"] <= most), block))
    inner = F.col("asked_block.first") + _last_within(F.col("asked_block.before"), F.col("asked_block.steps"), most)
    kept = F.when(F.col("n_tokens") <= most, F.col("n_chars")).when(F.col("asked_block").isNull(), F.lit(0).cast("long")).otherwise(inner)
    return rows.withColumn(name, kept).drop("asked_block")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, whether they are over the limit, and the characters of its longest prefix within the limit."""
    rows = longest_within(store_counts(table(spark, sf_dir, "documents")), F.lit(LIMIT))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "kept_chars")
