"""Every operator and stage on nulls, empty and long texts, repeats, clashing columns and empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tracelake.llm.queries import queries

#: The operators over documents; those over vectors have their own tests.
OPS = sorted(n for n in queries() if n.startswith("op") and n not in ("op12_centroid_clusters", "op13_vector_codes"))


@pytest.mark.parametrize("name", OPS)
def test_mixed_rows(spark, mixed, name):
    folder, docs, _ = mixed
    rows = queries()[name](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, nothing, name):
    assert queries()[name](spark, nothing).collect() == []


def test_stages_keep_columns_and_run_on_empty_tables(spark, mixed, nothing):
    for folder, ids in ((mixed[0], {d[0] for d in mixed[1]}), (nothing, set())):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert {r.doc_id for r in out.select("doc_id").collect()} <= ids


def test_reruns_agree(spark, mixed):
    folder = mixed[0]
    for name in ("op6_source_mixing", "op4_language_id", "op5_toxicity"):
        one, two = (sorted(map(tuple, queries()[name](spark, folder).collect()), key=repr) for _ in range(2))
        assert one == two


def test_components_of_few_and_of_many_links(spark, monkeypatch):
    """Links that one task holds are joined there, in few jobs; more go on by stars, with the same result."""
    import random

    from tracelake.llm import neardup

    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(len(root)):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    rows = spark.createDataFrame(links, "a long, b long")
    kept = []
    write = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: kept.append(name) or write(df, name))
    assert {r.node: r.component for r in neardup.connected_components(rows).collect()} == root
    assert len(kept) == 1
    monkeypatch.setattr(neardup, "JOINED", 50)
    assert {r.node: r.component for r in neardup.connected_components(rows).collect()} == root and len(kept) > 3


def test_cutting_holds_a_pass_of_texts(spark):
    """A batch of 40 MB is cut in parts; what is kept, its order and its counts are those of the whole."""
    import tracemalloc

    import pyarrow as pa

    from tracelake.llm import decontam

    clean = "plain words of no item " * 450
    texts = [clean if i % 4 else clean + "the secret phrase stands here" for i in range(3996)] + ["the secret phrase", None, "", clean]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": texts, "n_chars": [len(t or "") for t in texts]})
    del texts
    tracemalloc.start()
    rows = {}
    for out in decontam._cut(decontam.ItemAutomaton([("i", decontam.words_of("the secret phrase"))]), iter([batch]), 1, 2, 20):
        for doc, text, n in zip(*(out.column(c).to_pylist() for c in ("doc_id", "text", "n_chars")), strict=True):
            rows[doc] = (len(text or ""), n, "secret" in (text or ""))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(rows) == [i for i in range(4000) if i != 3996] and not any(s for _, _, s in rows.values())
    assert all(a == n for a, n, _ in rows.values()) and rows[0][0] == len(clean) + len(" stands here") and peak < 20 << 20


def test_sketching_holds_few_numbers(spark):
    """Texts of 8 MB are sketched in parts whose numbers stay below 64 MB; the sketches are those of each text alone."""
    import tracemalloc

    import pyarrow as pa

    from tracelake.llm import neardup

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    run = neardup.sketch_documents(Docs())
    texts = [" ".join(f"w{i}x{k}" for k in range(1100)) for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts})
    tracemalloc.start()
    sizes = [n for out in run(iter([batch])) for n in out.column("n_shingles").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [1096] * 1000 and peak < 64 << 20
    assert next(run(iter([batch.slice(700, 1)]))).to_pylist() == [r for out in run(iter([batch])) for r in out.to_pylist() if r["doc_id"] == 700]
