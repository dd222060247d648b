"""Secret scans through nested encodings by a worklist of decoded layers.

A text is the first layer. Each layer is scanned for secrets and decoded in place, in one way at a time: all its
percent-encoded stretches, all its Unicode escapes and character references, or all its base64 stretches are
replaced by what they stand for, and what is not encoded stays around them, so secrets may lie partly in a stretch.
Base64 that holds gzip, zlib or bzip2 data is expanded, again while the result is compressed. Each decoded layer goes on the
worklist until none is left; a layer whose text was seen before in the document is not worked on again, so cycles end.
A layer knows by runs of characters where it comes from, so a secret in any layer maps to a span of the document.

What a stretch expands to beyond ``WINDOW`` characters becomes layers of its own, one for each window; windows end at white
space and repeat the ``OVERLAP`` characters before, and all of a stretch maps to the same span, so nothing is lost between them.

Defined cases: null and empty texts have no spans; null ids are ids like others. Repeated rows give repeated results. A run of base64
signs is read from each of its alignments and separators on as far as it is UTF-8, or compressed data; of stretches that overlap the
longest counts, the first of equal ones, and reading goes on behind it. Lines of one length are also read as one stretch. Compressed
data that breaks off gives what came before. Nothing else bounds the layers of a document. An empty table gives an
empty result. Extra columns are ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain, islice
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import freeing, table

KINDS = ("assign", "access", "hex")
#: Characters of expanded data in one layer, about, and those that the next window repeats.
WINDOW = 4 << 20
OVERLAP = 4096

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINES = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{2,})+={0,2}")
#: Signs of the shortest base64 stretch that is decoded: fewer are words as often as not.
LEAST = 12
#: Of a run that isn't readable to its end: signs of the shortest readable part, and bytes from which on it need not be plain ASCII.
LEAST_PART, SURE = 16, 24
_PLAIN = re.compile(rb"[\x20-\x7e\t\r\n]*")
_STANDARD = str.maketrans("-_", "+/")
_SPACES = re.compile(r"\x20{65,}")


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base secrets of one text; the kind as its place in ``KINDS``."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text and the runs by which its characters come from the layer above: (first place, begin above, step, width)."""

    def __init__(self, text: str, above: Layer | None = None, runs: list[tuple[int, int, int, int]] | None = None):
        self.text, self.above, self.runs = text, above, runs or []
        self.starts = [r[0] for r in self.runs]

    def span(self, start: int, stop: int) -> tuple[int, int]:
        """The stretch of the document that characters come from."""
        layer = self
        while layer.above is not None:
            place, begin, step, _ = layer.runs[bisect_right(layer.starts, start) - 1]
            last, end, step_, width = layer.runs[bisect_right(layer.starts, stop - 1) - 1]
            start, stop = begin + step * (start - place), end + step_ * (stop - 1 - last) + width
            layer = layer.above
        return start, stop

    def replaced(self, found: list[tuple[int, int, str, int]]) -> Layer:
        """This layer with stretches (start, end, text, width) replaced, ``width`` characters making one of the new ones; 0: all of them."""
        out, runs, at, size = [], [], 0, 0
        for start, end, text, width in found:
            if start > at:
                runs.append((size, at, 1, 1))
                out.append(self.text[at:start])
                size += start - at
            if text:
                runs.append((size, start, width, width or end - start))
                out.append(text)
                size += len(text)
            at = end
        if at < len(self.text):
            runs.append((size, at, 1, 1))
            out.append(self.text[at:])
        return Layer("".join(out), self, runs)


def _percent(text: str) -> list[tuple[int, int, str, int]]:
    found = []
    for m in _PERCENT.finditer(text):
        raw = unquote_to_bytes(m[0])
        try:
            plain = raw.decode("utf-8")
        except UnicodeDecodeError:
            plain = raw.decode("latin-1")
        if len(plain) == len(raw):
            found.append((m.start(), m.end(), plain, 3))
            continue
        at = m.start()
        for c in plain:
            n = 3 * len(c.encode("utf-8"))
            found.append((at, at + n, c, n))
            at += n
    return found


def _escapes(text: str) -> list[tuple[int, int, str, int]]:
    found = []
    for m in _ESCAPE.finditer(text):
        if m[1]:
            point = 0x10000 + ((int(m[1], 16) & 0x3FF) << 10) + (int(m[2], 16) & 0x3FF)
        else:
            point = int(m[6]) if m[6] else int(m[3] or m[4] or m[5] or m[7], 16)
        if point <= 0x10FFFF:
            found.append((m.start(), m.end(), chr(point), 0))
    return found


def _unbase64(token: str) -> bytes | None:
    body = token.rstrip("=").translate(_STANDARD)
    body = body[: len(body) - 1] if len(body) % 4 == 1 else body
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or (len(head) > 2 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0)


def _expanded(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What compressed pieces expand to, a bounded piece at a time, as far as they are whole."""
    engine, rest, bzip = None, b"", False
    for piece in pieces:
        rest += piece
        try:
            while rest:
                if engine is None:
                    if not _is_packed(rest):
                        return
                    bzip = rest[:3] == b"BZh"
                    engine = bz2.BZ2Decompressor() if bzip else zlib.decompressobj(47)
                given, rest = rest, b""
                while True:
                    out = engine.decompress(given, WINDOW)
                    if out:
                        yield out
                    if engine.eof:
                        rest, engine = engine.unused_data, None
                        break
                    given = b"" if bzip else engine.unconsumed_tail
                    if (engine.needs_input if bzip else not given) and len(out) < WINDOW:
                        break
        except (zlib.error, OSError, ValueError):
            return


def _unpacked(raw: bytes) -> Iterator[str]:
    """Texts of about ``WINDOW`` characters that bytes expand to, being decompressed as long as they are compressed; none if they aren't."""
    pieces: Iterator[bytes] = iter([raw])
    head, seen, packed = raw, set(), False
    while _is_packed(head):
        key = hashlib.blake2b(head, digest_size=16).digest()
        if key in seen:
            return
        seen.add(key)
        pieces = _expanded(pieces)
        head = b""
        for piece in pieces:
            head += piece
            if len(head) >= WINDOW:
                break
        if not head:
            return
        packed = True
        pieces = _chained(head, pieces)
    if not packed:
        return
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for piece in pieces:
        held += decoder.decode(piece)
        if len(held) >= WINDOW:
            end = max(held.rfind(c) for c in " \n\t")
            if end > OVERLAP:
                yield held[: end + 1]
                held = _SPACES.sub(" " * 64, held[:end])[-OVERLAP:] + held[end:]
    held += decoder.decode(b"", True)
    if held:
        yield held


def _chained(head: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from rest


def _readable(raw: bytes) -> int:
    """How many bytes from the start on are UTF-8."""
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start
    return len(raw)


def _stretch(text: str, start: int, stop: int) -> tuple[int, Callable[[], Iterator[str]]] | None:
    """Where a base64 stretch from ``start`` on ends, as far as it is readable, and what it stands for; None if that is nothing."""
    if stop - start < LEAST:
        return None
    head = _unbase64(text[start : min(stop, start + 64)])
    if head is None:
        return None
    if _is_packed(head):
        raw = _unbase64(text[start:stop]) or b""
        return (stop, lambda: _unpacked(raw)) if next(_unpacked(raw), None) else None
    raw, good = head, _readable(head)
    if stop - start > 64 and good > 44:
        # at most a character that the head cuts off is missing: the rest is read too
        raw = _unbase64(text[start:stop]) or b""
        good = _readable(raw)
        whole = good == len(raw)
    else:
        whole = good == len(raw) and stop - start <= 64
    if not whole and good < SURE:
        # random signs are UTF-8 that far now and then, but hardly ever plain text
        good = len(_PLAIN.match(raw)[0])
    end = stop if whole else start + good // 3 * 4
    plain = (raw if whole else raw[: good // 3 * 3]).decode("utf-8", "ignore")
    return (end, lambda: iter([plain])) if end - start >= (LEAST if whole else LEAST_PART) and len(plain) >= 4 else None


def _run(text: str, start: int, stop: int) -> Iterator[tuple[int, int, Callable[[], Iterator[str]]]]:
    """The stretches of one run of base64 signs: at each alignment and after each separator, the longest of those that overlap."""
    cuts = [k + 1 for k in range(start, stop) if text[k] in "/-_+"]
    at, next_cut = start, 0
    while at < stop:
        while next_cut < len(cuts) and cuts[next_cut] <= at:
            next_cut += 1
        best = None
        for first in chain(range(at, min(at + 4, stop)), islice(cuts, next_cut, None)):
            if best and first >= best[1]:
                break
            found = _stretch(text, first, stop)
            if found and (best is None or found[0] - first > best[1] - best[0]):
                best = (first, *found)
                if found[0] == stop:
                    break
        if best is None:
            return
        yield best
        at = best[1]


def _wrapped(text: str) -> Iterator[tuple[int, int, Callable[[], Iterator[str]]]]:
    """Base64 that is broken into lines of one length, whose last may be shorter, as mail and key files hold it."""
    if "\n" not in text:
        return
    for m in _LINES.finditer(text):
        lines = list(re.finditer(r"[^\r\n]+", m[0]))
        size = len(lines[0][0])
        full = next((k for k, x in enumerate(lines) if len(x[0]) != size), len(lines))
        # a shorter line behind the full ones may be the last one or other text
        for n in (full + 1, full):
            if 1 < n <= len(lines) and len(lines[n - 1][0].rstrip("=")) <= size:
                whole = "".join(x[0] for x in lines[:n])
                found = _stretch(whole, 0, len(whole))
                if found and found[0] == len(whole):
                    yield m.start(), m.start() + lines[n - 1].end(), found[1]
                    break


def _base64(text: str) -> Iterator[tuple[int, int, Callable[[], Iterator[str]]]]:
    """(start, end, texts) of all base64 stretches, in order."""
    lines = list(_wrapped(text))
    at = 0
    for start, stop, texts in [*lines, (len(text), len(text), None)]:
        for m in _BASE64.finditer(text, at, start):
            yield from _run(text, m.start(), m.end())
        if texts:
            yield start, stop, texts
        at = stop


def decoded(layer: Layer) -> Iterator[Layer]:
    """The layers that a layer decodes to, one after the other."""
    text = layer.text
    if "%" in text and (found := _percent(text)):
        yield layer.replaced(found)
    if ("\\" in text or "&#" in text) and (found := _escapes(text)):
        yield layer.replaced(found)
    found, large, room = [], [], WINDOW
    for start, end, texts in _base64(text):
        some = list(islice(texts(), 2))
        if len(some) == 1 and len(some[0]) <= max(room, end - start):
            found.append((start, end, some[0], 0))
            room -= len(some[0])
        elif some:
            large.append((start, end, texts))
    if found:
        yield layer.replaced(found)
    del found
    for start, end, texts in large:
        for window in texts():
            yield Layer(window, layer, [(0, start, 0, end - start)])


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans, and the number of layers of one document. The worklist goes in depth, so of a layer's windows one is held at a time."""
    if not text:
        return [], [], 0
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    base = secrets(text)
    found, seen, layers = set(base), {digest(text)}, 1
    work = [decoded(Layer(text))]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        # a window counts once for each place that it stands for
        key = digest(inner.text) + (b"" if inner.runs[0][2] else b"%d" % inner.runs[0][1]) if len(inner.runs) == 1 else digest(inner.text)
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        for a, kind, b in secrets(inner.text):
            start, stop = inner.span(a, b)
            found.add((start, kind, stop))
        work.append(decoded(inner))
    return base, sorted(found), layers


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of every whole text, and how many layers it had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers")}
            for text in batch.column(1).to_pylist():
                base, every, layers = scan(text)
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
                out["n_layers"].append(layers)
            arrays = [pa.array(v, pa.string() if isinstance(c, str) and c in ("base_sha256", "spans") else pa.int64()) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *out])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freeing(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
