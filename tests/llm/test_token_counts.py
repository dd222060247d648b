"""Token counts at every prefix against the tokenizers library, and the store's answers against plain counting."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import tokencount
from tracelake.llm.queries import queries

PARTS = ["a", "e", "th", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'v", "1", "23", "é", "日本", "ß", "́", "😀", "!", "...", "<|endoftext|>", "<|endo", "|>", "\x1c", "\x85", "\xa0", "　", "​", " '", "Hello", " world", "the", "ing", "aaaaaaaaa", "----", "|"]


@pytest.fixture(scope="module")
def library():
    whole = Tokenizer.from_file(tokencount.vocabulary_path())
    return lambda text: len(whole.encode(text, add_special_tokens=False).ids)


def some_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("learnt", [False, True])
def test_every_prefix(library, learnt):
    counter = tokencount.PrefixCounter(tokencount.vocabulary_path(), kept=300)
    texts = some_texts(400)
    for k in range(0, len(texts), 50):
        if learnt:
            counter.learn(texts[k : k + 50])
        for t in texts[k : k + 50]:
            assert np.cumsum(counter.steps(t)).tolist() == [library(t[:i]) for i in range(1, len(t) + 1)], repr(t)


def test_every_code_point(library):
    counter = tokencount.PrefixCounter(tokencount.vocabulary_path())
    for k in range(1, 0x110000, 500):
        text = " ".join(f"a{c}1{c}! {c}\n{c}" for c in map(chr, range(k, min(k + 500, 0x110000))) if not 0xD800 <= ord(c) < 0xE000)
        assert counter.steps(text).sum() == (library(text) if text else 0), hex(k)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokencount.PrefixCounter(tokencount.vocabulary_path("word_bpe_49k.json"))


def test_query_counts_like_the_library(spark, mixed, library):
    folder, docs, _ = mixed
    got = {r.doc_id: r for r in queries()["op11_token_counts"](spark, folder).collect()}
    for i, text, *_ in docs:
        n = library(text or "")
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024)
        if text and len(text) < 3000:
            assert got[i].kept_chars == max(k for k in range(len(text) + 1) if library(text[:k]) <= 1024)


@pytest.mark.parametrize("block_chars", [3, 4096])
def test_store_answers(spark, tmp_path, library, block_chars):
    rows = [(i, t) for i, t in enumerate([None, "", *some_texts(60, 3)])] + [(None, "no id"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("mine"))
    store = tokencount.store_counts(docs, block_chars=block_chars)
    texts = sorted((t or "" for _, t in rows), key=lambda t: (library(t), len(t)))
    assert sorted((r.n_tokens, r.n_chars) for r in store.collect()) == [(library(t), len(t)) for t in texts]
    by_id = dict(rows[:62])
    for budget in (0, 1, 3, 100):
        for r in tokencount.longest_within(store, F.lit(budget)).where("doc_id <> 7").collect():
            t = by_id[r.doc_id] or ""
            assert r.kept_chars == max(k for k in range(len(t) + 1) if library(t[:k]) <= budget)
    for n in (-1, 0, 2, 5, 1000):
        for r in tokencount.tokens_at(store, F.lit(n)).where("doc_id <> 7").collect():
            assert r.tokens == library((by_id[r.doc_id] or "")[: max(n, 0)])
