"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are short lexicon rules (a word, or the first letters of a word) mined from labelled rows by
their likelihood ratio, and patterns (shouting, exclamation runs, repeated letters, pipes, digits).
A label model takes only their votes: EM over the unknown true label estimates how often each voter
fires on either class, then the voters' correlations given that label, by which the evidence of
voters that say the same thing is divided. Its posteriors, not the labels, train a logistic
classifier over the voters, which scores every text.

Labels are read only from rows that are not held out, at most ``SAMPLE_ROWS`` of them; the sample is
drawn by id hash, so it is the same in every run.

Defined cases: null and empty texts fire no voter and get the classifier's base score. Repeated
documents get equal scores. With no labelled rows every score is 0. A document with several label
rows is toxic if any says so. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import freeing, table, written
from tracelake.llm.langid import is_held_out

#: Labelled rows that voters and label model are fitted on, at most (about).
SAMPLE_ROWS = 12_000
#: Lexicon voters, at most, and the likelihood ratio statistic each must reach.
MAX_TERMS = 600
LEAST_RATIO = 12.0
#: Correlation, given the label, from which two voters count as saying the same.
SAME_VOICE = 0.4
LEAST_DOCS = 3
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("shouting", "exclaims", "stretched", "piped", "digits", "symbols")


def pattern_votes(text: str) -> list[str]:
    """The pattern voters that fire on a text."""
    n = max(1, len(text))
    upper = sum(map(text.count, "AEIOTN"))
    lower = sum(map(text.count, "aeiotn"))
    fired = (upper > lower, text.count("!!") * 200 > n, bool(re.search(r"([A-Za-z])\1{3}", text)), text.count(" | ") * 100 > n, sum(map(text.count, "0123456789")) * 10 > n, (text.count("#") + text.count("$") + text.count("%")) * 20 > n)
    return [p for p, f in zip(PATTERNS, fired, strict=True) if f]


def terms_of(words: set[str]) -> set[str]:
    """Lexicon terms: each word as ``=word``, and its first letters as ``^letters``."""
    out = {f"={w}" for w in words}
    for n in PREFIXES:
        out.update(f"^{w[:n]}" for w in words if len(w) > n)
    return out


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class ToxicityModel:
    words: dict[str, int] = field(default_factory=dict)
    prefixes: dict[str, int] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -50.0
    accuracies: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def voters(self, text: str | None) -> list[int]:
        """Places of the voters that fire."""
        if not text:
            return []
        words = words_of(text)
        found = {self.words[w] for w in words & self.words.keys()}
        if self.prefixes:
            for n in PREFIXES:
                found.update(self.prefixes[p] for p in {w[:n] for w in words if len(w) > n} & self.prefixes.keys())
        base = len(self.names) - len(PATTERNS)
        return sorted(found) + [base + PATTERNS.index(p) for p in pattern_votes(text)]

    def score(self, text: str | None) -> float:
        if not self.names:
            return 0.0
        z = self.bias + float(self.weights[self.voters(text)].sum())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over the hidden label of the 0/1 votes [row, voter]: posteriors, firing rates [voter, class] and correlations given the label.

    A single voter's silence is an abstention. That no lexicon voter speaks at all is a vote of its own, whose rates are learnt like
    the others'. The first posteriors are the shares of rows by whether a lexicon voter speaks, so that the label with more votes is the toxic one."""
    voters = votes.shape[1]
    silent = ~votes[:, : voters - len(PATTERNS)].any(axis=1)
    fired = np.concatenate([votes, silent[:, None]], axis=1).astype(np.float64)
    post = np.where(silent, 0.1 * prior, 1 - 0.5 * prior)
    rates, corr = np.zeros((voters + 1, 2)), np.eye(voters + 1)
    for _ in range(rounds):
        mass = np.array([(1 - post).sum(), post.sum()])
        # what is added keeps the rates off 0
        rates = np.stack([((1 - post) @ fired + 0.05) / (mass[0] + 5), (post @ fired + 0.5) / (mass[1] + 5)], axis=1)
        rest = fired - (post[:, None] * (post @ fired / mass[1]) + (1 - post)[:, None] * ((1 - post) @ fired / mass[0]))
        scale = np.sqrt(np.maximum(1e-12, (rest**2).sum(axis=0)))
        corr = (rest.T @ rest) / np.outer(scale, scale)
        # a voter that agrees with others beyond the label's doing shares its evidence with them
        share = 1 / np.maximum(1.0, np.where(corr > SAME_VOICE, corr, 0).sum(axis=1))
        before, post = post, 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + fired @ (np.log(rates[:, 1] / rates[:, 0]) * share), -50, 50)))
        if np.abs(post - before).max() < 1e-4:
            break
    return post, rates[:-1], corr[:-1, :-1]


def linear_classifier(votes: np.ndarray, target: np.ndarray, rounds: int = 12, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton steps."""
    x = np.concatenate([votes, np.ones((len(votes), 1))], axis=1).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = np.maximum(p * (1 - p), 1e-6)
        w -= np.linalg.solve((x * slope[:, None]).T @ x + np.diag(penalty), x.T @ (p - target) + penalty * w)
    return w[:-1], float(w[-1])


def distinct_terms(terms: list[tuple[str, int]]) -> list[str]:
    """Terms, best first, without those that a kept prefix covers or that fire with a kept longer term."""
    kept: list[tuple[str, int]] = []
    for term, docs in terms:
        body = term[1:]
        covered = any(k[0] == "^" and body.startswith(k[1:]) for k, _ in kept)
        echoed = term[0] == "^" and any(k[1:].startswith(body) and docs <= 1.1 * n for k, n in kept)
        if not covered and not echoed:
            kept.append((term, docs))
    return [k for k, _ in kept]


def _labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic, text) of about ``rows`` labelled documents that are not held out."""
    known = labels.where(~is_held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, rows / max(1, n))
    rank = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 62) - 1))
    # at most about SAMPLE_ROWS ids and flags: a bounded side to broadcast
    chosen = known.where(rank <= int(share * ((1 << 62) - 1)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Mine voters, fit the label model and train the classifier."""
    train = written(_labelled_sample(docs, labels, sample_rows), "toxic-sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(texts), 50):
                rows = [sorted(terms_of(words_of(t))) for t in texts[k : k + 50]]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[k : k + 50], pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["toxic", "terms"])

    per_class = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = per_class.get(1, 0), per_class.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel()
    terms = train.select(F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(freeing(extract), "toxic long, terms array<string>")
    counts = terms.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    expected = F.col("n") * n1 / (n1 + n0)
    other = F.col("n") - F.col("pos")
    ratio = 2 * (F.col("pos") * F.log(F.col("pos") / expected) + F.when(other > 0, other * F.log(other / (F.col("n") - expected))).otherwise(0.0))
    seen = terms.select(F.explode("terms").alias("term")).agg(F.approx_count_distinct("term")).first()[0]
    # of so many terms some reach a high ratio by chance; the bar rises with their number
    least = max(LEAST_RATIO, 2 * math.log(max(2, seen)) - 8)
    best = counts.where((F.col("pos") >= LEAST_DOCS) & (F.col("pos") > 2 * expected) & (4 * other <= F.col("pos"))).withColumn("ratio", ratio).where(F.col("ratio") >= least).orderBy(F.desc("ratio"), "term").limit(MAX_TERMS).select("term", "pos").collect()
    lexicon = distinct_terms([(r["term"], r["pos"]) for r in best])
    model = ToxicityModel({t[1:]: k for k, t in enumerate(lexicon) if t[0] == "="}, {t[1:]: k for k, t in enumerate(lexicon) if t[0] == "^"}, [*lexicon, *PATTERNS])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.voters(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "voters"])

    fired = sorted((r["doc_id"], r["voters"]) for r in train.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freeing(vote), "doc_id long, voters array<int>").collect())
    votes = np.zeros((len(fired), len(model.names)), np.float32)
    for k, (_, places) in enumerate(fired):
        votes[k, places] = 1
    post, model.accuracies, model.correlations = label_model(votes, min(0.5, max(0.01, n1 / (n1 + n0))))
    model.weights, model.bias = linear_classifier(votes, post)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score and decision of every whole text."""
    lean = ToxicityModel(model.words, model.prefixes, model.names, model.weights, model.bias)
    shared = docs.sparkSession.sparkContext.broadcast(lean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freeing(run), "doc_id long, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
