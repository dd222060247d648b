"""Scores of a text against a reference text: ROUGE-L, BLEU, token F1, compression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCORES = ("rouge_l", "bleu", "f1", "compression_ratio", "rouge_l_ceiling", "rouge_l_normalised", "lead_combined")


def tokenise(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by one big integer as a bit row."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & where.get(t, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def harmonic(a: float, b: float) -> float:
    return 2 * a * b / (a + b) if a + b else 0.0


def overlap(a: list[str], b: list[str], n: int) -> int:
    grams = [Counter(zip(*(t[k:] for k in range(n)), strict=False)) for t in (a, b)]
    return (grams[0] & grams[1]).total()


def lexical(text: list[str], reference: list[str]) -> tuple[float, float, float]:
    """(ROUGE-L, BLEU, token F1)."""
    if not text or not reference:
        return 0.0, 0.0, 0.0
    lcs, same = common_subsequence(text, reference), overlap(text, reference, 1)
    shares = [overlap(text, reference, n) / (len(text) - n + 1) for n in range(1, min(4, len(text)) + 1)]
    bleu = math.exp(sum(map(math.log, shares)) / len(shares)) * min(1.0, math.exp(1 - len(reference) / len(text))) if all(shares) else 0.0
    return harmonic(lcs / len(text), lcs / len(reference)), bleu, harmonic(same / len(text), same / len(reference))


def score(text: str | None, reference: str | None) -> dict[str, float]:
    mine, theirs = tokenise(text), tokenise(reference)
    rouge, bleu, f1 = lexical(mine, theirs)
    ratio = len(mine) / len(theirs) if theirs else 0.0
    ceiling = harmonic(1.0, ratio) if ratio else 0.0
    lead = sum(lexical(theirs[: len(mine)], theirs)) / 3
    return dict(zip(SCORES, (rouge, bleu, f1, round(ratio, 4), round(ceiling, 4), round(rouge / ceiling, 4) if ceiling else 0.0, round(lead, 4)), strict=True))


def scored(pairs: DataFrame, key: str, text: str, reference: str) -> DataFrame:
    """Scores of each row's text against its reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [score(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[s] for r in rows], pa.float64()) for s in SCORES)], [key, *SCORES])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, text, reference).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{s} double" for s in SCORES)]))
