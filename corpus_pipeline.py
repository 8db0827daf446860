"""The corpus pipeline: documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's documents.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontam, near_dup, packing, site_quality, toxicity
from riskloom.llm.queries import tokenizer_path
from riskloom.llm.tables import DOC_COLUMNS, read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least one half; null and empty
    texts, null ids and repeated rows are scored like any other row."""
    scored = site_quality.score(docs.select(DOC_COLUMNS), read(spark, sf_dir, "labels"))
    return scored.where(F.col(site_quality.OWN)["quality"] >= 0.5).select(DOC_COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half; a null or empty text
    has no clause and stays, repeated rows share their text's verdict."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return docs.select(DOC_COLUMNS).where(~toxicity.is_toxic(F.col("text"), model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: its least doc_id, and of unlike texts under
    that doc_id the one in the class.  Null texts, repeated rows and rows without
    a doc_id as in ``near_dup.one_of_each``; an empty table gives no rows."""
    return near_dup.one_of_each(docs, DOC_COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; a null or empty text holds none."""
    return docs.select(DOC_COLUMNS).where(~decontam.holds_item(F.col("text"), read(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of every document that is left; a null text is its end id."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# Trained models and tokenizers have no SQL form; tests/llm/test_pipeline.py
# compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
