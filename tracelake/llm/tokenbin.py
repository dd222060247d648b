"""Token ids in a binary plane format: fixed-size id blocks, transposed into byte or bit planes, zstandard per plane.

Layout. Documents are dealt by ranges of ``doc_id`` into shards, sorted, encoded, and packed into
*frames*: one frame holds whole documents and is one row of a Parquet table (the shared store that
every Spark cluster can write and read). A frame's ``payload`` is, in little-endian order,

    magic "TLBP" | plane kind u8 (0 byte, 1 bit) | 3 zero bytes | block size u32 | ids u64 | blocks u32 |
    chunk index: for each block its id count u32 and the compressed size u32 of each plane |
    the compressed planes, block after block

Every block has ``block_ids`` ids but the last of a frame. A u32 id makes 4 byte planes or 32 bit
planes; high planes of small ids are all zero and shrink to a few bytes. Beside the payload each
frame has its shard, its place in the shard, and its documents' ids and lengths; the shard totals
give every document its place in the whole stream.

Tokenising. White space never joins the tokens on its sides in the vocabulary used here, so a text
is cut into pieces at spaces and newlines. The vocabulary's own rules cut a piece of ASCII and
Latin-1 letters further: into small runs of letters, single digits and runs of signs, which numpy
finds in the bytes of many texts at once. Pieces with other symbols, contractions or "<|" stay
whole, and so do all of a vocabulary with other rules. Each distinct word or piece is encoded once
per worker by the tokenizers library and kept in a bounded table.

Defined cases: a null or empty text is the end id alone. Repeated document rows are encoded each,
in the order of their texts. An empty table gives no frames. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import PASS_BYTES, freeing, passes, table, text_bytes, written
from tracelake.llm.tokencount import byte_letters

END_ID = 2
BLOCK_IDS = 65_536
#: Ids after which a frame is closed at the next document's end.
FRAME_IDS = 1 << 20
#: Words and pieces that a worker keeps encoded; the table starts anew beyond it.
KEPT_PIECES = 1_000_000
#: A symbol that is one token by itself, put between pieces that are encoded together.
_MARK = "~"

_HEAD = struct.Struct("<4sB3xIQI")
FRAME_SCHEMA = "shard int, frame int, shard_start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"
_FRAME = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of bytes. Signs are all other printable ASCII; what a piece holds of unplain bytes makes it unplain as a whole.
_SPACE, _LETTER, _DIGIT, _SIGN, _UNPLAIN = range(5)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _UNPLAIN, np.uint8)
    kinds[33:127] = _SIGN
    kinds[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
    kinds[48:58] = _DIGIT
    kinds[[10, 32]] = _SPACE
    return kinds


_KINDS = _byte_kinds()
#: Bytes that become small by adding 32 if they stand in a letter: A-Z, and the second bytes of the letters from U+00C0 to U+00DE.
_CAPITAL = np.isin(np.arange(256), [*range(65, 91), *range(0x80, 0x9F)])
#: Letters that may begin the end of a contraction ('s 't 're 've 'm 'll 'd).
_CONTRACTED = np.isin(np.arange(256), list(b"strvmldSTRVMLD"))
_CUT = re.compile(r"[ \n]")
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PLAIN_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_PLAIN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class PieceEncoder:
    """Encodes texts by their distinct words; equal to encoding them whole."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        mark = self._ids(_MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self.plain = None
        if spec["normalizer"] == _PLAIN_NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_PLAIN_SPLIT, _PLAIN_BYTES]} and suffix and all(re.fullmatch(r"<\|[a-z]+\|>", t["content"]) and not (t["normalized"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"]):
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.closing = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
            self.closing[[k for t, k in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            self.letters = {b: c for c, b in byte_letters().items() if b != 32}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends, self.weight = array("I"), array("q", [0]), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Enter words whose ids stand one after the other."""
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ends.frombytes((np.asarray(ends, np.int64) + len(self.ids)).tobytes())
        self.ids.frombytes(np.asarray(ids, np.uint32).tobytes())

    def _learn_plain(self, words: list[str]) -> None:
        """Words of one kind of bytes, as the model alone encodes them; each ends at its one token with the suffix."""
        for k in range(0, len(words), 5000):
            some = words[k : k + 5000]
            lines = [" ".join(some[j : j + 200]) for j in range(0, len(some), 200)]
            lines = [t if t.isascii() else t.encode().decode("latin-1").translate(self.letters) for t in lines]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(some):
                self._keep(some, ids, ends)
            else:
                self._learn(some)

    def _learn(self, pieces: list[str]) -> None:
        """Pieces of any symbols, by the whole tokenizer."""
        alone = {p for p in pieces if self.mark is None or _MARK in p or len(p) > 1000}
        together = [p for p in pieces if p not in alone]
        for k in range(0, len(together), 200):
            some = together[k : k + 200]
            ids = self._ids(f" {_MARK} ".join(some))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(some) - 1:
                self._keep(some, np.delete(ids, cuts), np.append(cuts - np.arange(len(cuts)), len(ids) - len(cuts)))
            else:
                alone.update(some)
        for p in alone:
            ids = self._ids(p)
            self._keep([p], ids, np.array([len(ids)]))

    def _words(self, raw: np.ndarray, at: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The words of texts, which lie one after the other, in small letters, and where each text's words begin and end. Unplain pieces stay as they are."""
        n, begins = len(raw), at[:-1][at[:-1] < at[1:]]
        kinds = _KINDS[raw] if self.plain else np.where((raw == 10) | (raw == 32), np.uint8(_SPACE), np.uint8(_UNPLAIN))
        if self.plain:
            two = np.flatnonzero(raw == 0xC3)
            sign = np.isin(raw[two + 1], (0x97, 0xB7))
            kinds[two + 1] = np.where(sign, _UNPLAIN, _LETTER)
            for first, second in ((0x27, _CONTRACTED), (0x3C, np.arange(256) == 0x7C)):
                seen = np.flatnonzero(raw[:-1] == first)
                kinds[seen[second[raw[seen + 1]]]] = _UNPLAIN
        if kinds.max(initial=0) == _UNPLAIN:
            cut = kinds == _SPACE
            cut[begins] = True
            cut = np.flatnonzero(cut)
            unplain = np.maximum.reduceat(kinds, cut) == _UNPLAIN
            kinds[np.repeat(unplain, np.diff(cut, append=n)) & (kinds != _SPACE)] = _UNPLAIN
        first = np.ones(n, bool)
        np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
        first |= kinds == _DIGIT
        first[begins] = True
        first = np.flatnonzero(first)
        word = kinds[first] != _SPACE
        offsets = np.zeros(1 + np.count_nonzero(word), np.int64)
        np.cumsum(np.diff(first, append=n)[word], out=offsets[1:])
        small = (raw + np.uint8(32) * (_CAPITAL[raw] & (kinds == _LETTER)))[kinds != _SPACE]
        words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(small))
        return words, np.searchsorted(first[word], at)

    def encode(self, texts: list[str | None], limit: int = PASS_BYTES) -> list[bytes]:
        """The ids of each text as little-endian u32 bytes. A text of more than ``limit`` symbols goes part by part, cut at white space."""
        if len(texts) == 1 and len(texts[0] or "") > limit:
            text, cuts = texts[0], [0]
            while (space := _CUT.search(text, cuts[-1] + limit)) is not None:
                cuts.append(space.start())
            return [b"".join(self._encode([text[a:b]])[0] for a, b in zip(cuts, [*cuts[1:], None], strict=True))]
        return self._encode(texts)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        words, at = self._words(*text_bytes(pa.array(texts, pa.large_string())))
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.known]
        if self.weight + len(new) > self.kept:
            self._forget()
            new = distinct
        plain = [w for w in new if self.plain and _PLAIN.fullmatch(w)]
        if plain:
            self._learn_plain(plain)
        if len(plain) < len(new):
            self._learn([w for w in new if w not in self.known])
        self.weight += sum(1 + len(w) // 64 for w in new)
        slots = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        ends, codes = np.frombuffer(self.ends, np.int64), coded.indices.to_numpy()
        sizes = (ends[slots + 1] - ends[slots])[codes]
        stops = np.zeros(1 + len(sizes), np.int64)
        np.cumsum(sizes, out=stops[1:])
        places = np.repeat(ends[slots][codes] - stops[:-1], sizes) + np.arange(stops[-1])
        stream = np.frombuffer(self.ids, np.uint32)[places].astype("<u4", copy=False) if len(places) else np.zeros(0, "<u4")
        raw, cuts = stream.tobytes(), (4 * stops[at]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The byte (0) or bit (1) planes of u32 ids, lowest first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not kind:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def unplaned(parts: list[bytes], n: int, kind: int) -> np.ndarray:
    """The ids of ``n`` from their planes."""
    if not kind:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


def pack(ids: np.ndarray, *, block_ids: int = BLOCK_IDS, kind: int = 0, level: int = 3) -> bytes:
    """A frame's payload."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level).compress
    index, body = [], []
    for k in range(0, len(ids), block_ids):
        block = ids[k : k + block_ids]
        parts = [squeeze(p) for p in planes(block, kind)]
        index.append(struct.pack(f"<{1 + len(parts)}I", len(block), *map(len, parts)))
        body += parts
    return b"".join([_HEAD.pack(b"TLBP", kind, block_ids, len(ids), len(index)), *index, *body])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload; raises ValueError if it isn't whole."""
    import zstandard

    magic, kind, _, n, blocks = _HEAD.unpack_from(payload)
    if magic != b"TLBP":
        raise ValueError("not a plane payload")
    expand = zstandard.ZstdDecompressor().decompress
    width = 32 if kind else 4
    entries = np.frombuffer(payload, "<u4", blocks * (1 + width), _HEAD.size).reshape(blocks, 1 + width)
    at, out = _HEAD.size + entries.nbytes, []
    for count, *sizes in entries.tolist():
        parts = []
        for s in sizes:
            parts.append(expand(payload[at : at + s]))
            at += s
        out.append(unplaned(parts, count, kind))
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    if len(ids) != n or at != len(payload):
        raise ValueError("a payload of the wrong length")
    return ids


def write_token_frames(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, frame_ids: int = FRAME_IDS, kind: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, pack and write all documents in ascending ``doc_id`` order; the written frames, read back."""
    path = tokenizer or vocabulary_path()
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, frame, start = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        doc_ids: list[int] = []

        def closed() -> pa.RecordBatch:
            stream = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_pylist([{"shard": shard, "frame": frame, "shard_start": start, "n_ids": len(stream), "doc_ids": doc_ids, "doc_lengths": [len(x) // 4 for x in ids], "payload": pack(stream, block_ids=block_ids, kind=kind)}], _FRAME)

        held = 0
        for batch in batches:
            for part in passes(batch, "text", 8 << 20):
                for doc_id, raw in zip(part.column(0).to_pylist(), _encoder(path).encode(part.column(1).to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(raw + end)
                    held += len(raw) // 4 + 1
                    if held >= frame_ids:
                        yield closed()
                        frame, start, held, ids, doc_ids = frame + 1, start + held, 0, [], []
        if doc_ids:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frames = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(freeing(encode), FRAME_SCHEMA)
    return written(frames, "token-frames")


def read_documents(frames: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """One row per document from the written frames: its place in its shard, its length, its checksum and, if asked for, its ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"])
                ends = np.cumsum(r["doc_lengths"])
                starts = ends - r["doc_lengths"]
                out = {"doc_id": r["doc_ids"], "shard": [r["shard"]] * len(starts), "shard_start": (starts + r["shard_start"]).tolist(), "n_tokens": r["doc_lengths"], "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]}
                if with_ids:
                    out["ids"] = [ids[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])]))

    return frames.mapInArrow(freeing(decode), "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def document_stream(frames: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """``read_documents`` with each document's ``start`` in the whole stream. The shard totals are one row a shard, a number the writer sets."""
    totals = frames.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("offset"))
    docs = read_documents(frames, with_ids=with_ids).join(F.broadcast(offsets), "shard")
    return docs.select("doc_id", (F.col("offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_stream(write_token_frames(table(spark, sf_dir, "documents")))
