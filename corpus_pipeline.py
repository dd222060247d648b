"""A training-data pipeline over ``documents``: filter, de-duplicate, decontaminate, mix, and write token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next stage's documents. All but the last return the columns of ``documents``.

* quality: documents over their language's perplexity bar go;
* near_dedup: of each group of near-duplicates the document with the least id stays;
* decontaminate: contaminated documents go, and shorter benchmark passages are cut from the others;
* mix: each document's text becomes what the source mix takes of it;
* token_ids: the texts are encoded and written in the plane format; one row per document is read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import table, written
from tracelake.llm.decontam import remove_contamination
from tracelake.llm.mixing import mix_documents
from tracelake.llm.neardup import keep_first
from tracelake.llm.quality import keep_quality
from tracelake.llm.tokenbin import document_stream, write_token_frames


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return document_stream(write_token_frames(docs))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_ids", token_ids)]

#: The language model of the first stage and the tokenizer of the last are no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
