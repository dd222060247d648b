"""Telephony audio columns: mu-law and A-law by lookup table, IMA ADPCM blocks decoded across blocks, resampled PCM.

A payload is stored losslessly as the 8-bit samples (or ADPCM block bytes) of a RIFF/WAVE file:
format 7 (mu-law), 6 (A-law) or 0x11 (IMA ADPCM with 576-byte blocks). ``encode_media`` writes such
files, ``decode_media`` reads them back, expands them to 16-bit PCM and resamples.

ADPCM steps depend on the step before, so numpy runs over all blocks of many rows at once, one step
of every block at a time; a block's header gives its first sample and step index, so blocks are
independent. A header index beyond the step table counts as its last entry.

Defined cases: a null or empty text is one block of padding. Repeated rows give repeated results;
equal texts always give equal values. An empty table gives an empty result. Extra columns are
ignored. ``decode_media`` raises ValueError on bytes that are no such file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import freeing, passes, table, written

RATE = 8000
BLOCK = 576
PAD = b"\xff"
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}

#: Fixed values of the public IMA ADPCM format: change of the step index by the code's low three bits.
_INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Fixed values of the public IMA ADPCM format: the step sizes.
_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def mulaw_table() -> np.ndarray:
    """The 256 linear values of G.711 mu-law."""
    code = ~np.arange(256, dtype=np.uint8)
    segment, step = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    value = ((2 * step + 33) << (segment + 2)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 256 linear values of G.711 A-law."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    segment, step = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    value = np.where(segment, (2 * step + 33) << (np.maximum(segment, 1) + 2), (2 * step + 1) << 3)
    return np.where(code & 128, value, -value).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}
#: The signed change of the predictor by step index and 4-bit code, and the next index, both derived from the step sizes.
_CODE = np.arange(16, dtype=np.int32)
_CHANGE = sum(np.where(_CODE & bit, _STEPS[:, None] >> shift, 0) for bit, shift in ((4, 0), (2, 1), (1, 2))) + (_STEPS[:, None] >> 3)
_CHANGE = np.where(_CODE & 8, -_CHANGE, _CHANGE).astype(np.int32).ravel()
_NEXT = (np.clip(np.arange(len(_STEPS), dtype=np.int32)[:, None] + _INDEX_CHANGE[_CODE & 7], 0, len(_STEPS) - 1) * 16).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples [blocks, 2 * (bytes - 4) + 1] of mono IMA ADPCM blocks [blocks, bytes]."""
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    at = np.minimum(blocks[:, 2], len(_STEPS) - 1).astype(np.int32) * 16
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = value
    for k in range(size - 4):
        for row, nibble in ((2 * k + 1, data[k] & 15), (2 * k + 2, data[k] >> 4)):
            code = at + nibble
            value += _CHANGE[code]
            np.clip(value, -32768, 32767, out=value)
            at = _NEXT[code]
            out[row] = value
    return np.ascontiguousarray(out.T)


def resampled(pcm: np.ndarray, ends: np.ndarray, up: int = 2) -> np.ndarray:
    """Each recording of ``pcm`` (they end at ``ends``) at ``up`` times its rate by linear interpolation; its last sample is held."""
    after = np.empty(len(pcm), np.int32)
    after[:-1] = pcm[1:]
    after[ends - 1] = pcm[ends - 1]
    out = np.empty((len(pcm), up), np.int16)
    for k in range(up):
        out[:, k] = (pcm.astype(np.int32) * (up - k) + after * k) // up
    return out.ravel()


def wave_header(codec: str, n: int, rate: int = RATE) -> bytes:
    """The RIFF/WAVE header before ``n`` data bytes."""
    extra = struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if codec == "adpcm" else struct.pack("<H", 0)
    bits, align = (4, BLOCK) if codec == "adpcm" else (8, 1)
    per_second = rate * BLOCK // (2 * (BLOCK - 4) + 1) if codec == "adpcm" else rate
    fmt = struct.pack("<HHIIHH", CODECS[codec], 1, rate, per_second, align, bits) + extra
    return struct.pack("<4sI4s4sI", b"RIFF", 20 + len(fmt) + n, b"WAVE", b"fmt ", len(fmt)) + fmt + struct.pack("<4sI", b"data", n)


def wave_payload(media: bytes) -> tuple[str, bytes]:
    """Codec and data of a file that ``wave_header`` began."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        raise ValueError("not a WAVE file")
    (size,) = struct.unpack_from("<I", media, 16)
    (form,) = struct.unpack_from("<H", media, 20)
    tag, n = struct.unpack_from("<4sI", media, 20 + size)
    codec = next((c for c, f in CODECS.items() if f == form), None)
    data = media[28 + size :]
    if codec is None or tag != b"data" or len(data) != n:
        raise ValueError("a WAVE file of another kind or length")
    return codec, data


def encode_media(docs: DataFrame, *, codec: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as WAVE files. Without ``codec`` the bytes' CRC-32 picks one of the three, so equal texts agree."""
    names = list(CODECS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                n_bytes, codecs, media = [], [], []
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    kind = codec or names[zlib.crc32(raw) % len(names)]
                    padded = raw + PAD * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0)
                    n_bytes.append(len(raw))
                    codecs.append(kind)
                    media.append(wave_header(kind, len(padded)) + padded)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(codecs), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "codec", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(encode), "doc_id long, n_bytes long, codec string, media binary")


def _expanded(files: list[tuple[str, bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """PCM of each file at its own and at twice its rate; files of one codec are worked on together."""
    out: list = [None] * len(files)
    for codec in CODECS:
        mine = [k for k, f in enumerate(files) if f[0] == codec]
        if not mine:
            continue
        data = np.frombuffer(b"".join(files[k][1] for k in mine), np.uint8)
        sizes = np.array([len(files[k][1]) for k in mine])
        if codec == "adpcm":
            pcm = decode_adpcm(data.reshape(-1, BLOCK)).ravel()
            sizes = sizes // BLOCK * (2 * (BLOCK - 4) + 1)
        else:
            pcm = TABLES[codec][data]
        ends = np.cumsum(sizes)
        wide = resampled(pcm, ends)
        for k, a, b in zip(mine, ends - sizes, ends, strict=True):
            out[k] = pcm[a:b], wide[2 * a : 2 * b]
    return out


def decode_media(media: DataFrame, *, with_pcm: bool = False) -> DataFrame:
    """Digests and audio features of stored files and, if asked for, their PCM at 16 kHz as little-endian 16-bit samples."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", pcm binary" if with_pcm else "")
    fields = [(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "media"):
                rows = []
                stored = part.column(2).to_pylist()
                files = [wave_payload(m) for m in stored]
                for doc_id, n_bytes, m, (codec, data), (pcm, wide) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), stored, files, _expanded(files), strict=True):
                    level = float(np.sqrt(np.mean(np.square(pcm, dtype=np.float32), dtype=np.float64)))
                    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
                    row = {"doc_id": doc_id, "n_bytes": n_bytes, "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-32:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest()}
                    row["feature"] = f"{codec};samples={len(pcm)};rms={level:.1f};peak={int(np.abs(pcm.astype(np.int32)).max())};crossings={crossings};pcm16k_crc32={zlib.crc32(wide)}"
                    if with_pcm:
                        row["pcm"] = wide.astype("<i2").tobytes()
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(freeing(decode), schema)


def store_pcm(media: DataFrame) -> DataFrame:
    """The resampled PCM of stored files, written to the shared folder and read back."""
    return written(decode_media(media, with_pcm=True), "pcm16k")


def op3_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(written(encode_media(table(spark, sf_dir, "documents")), "media"))
