"""A corpus pipeline: stages over `documents`, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.llm import langid, line_dedup, packing, pii, simhash
from astrolake.session import drop_table, write_table

# Documents whose language has a smaller mean share of the words than this are rejected.
MIN_LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.  Rejected are texts without letters and texts whose words are
    of no clear language; the columns stay as they are.  Where no row has a label to learn from, all
    documents stay."""
    model = langid.train(docs, "doc_id", "text", "lang")
    if not model.languages:
        return docs
    judged = langid.predict(docs, "text", model, "_language", "_share")
    kept = judged.where(f"_language <> '{langid.UNKNOWN}' AND _share >= {MIN_LANGUAGE_SHARE}")
    return kept.select(*docs.columns)


def _recounted(docs: DataFrame) -> DataFrame:
    """`n_chars` again tells the length of the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs in several of them."""
    return _recounted(line_dedup.drop_recurring_lines(docs, "doc_id", "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 3-word shingles, at most 2 differing bits."""
    return simhash.one_per_group(docs, "doc_id", "text", words=3, max_bits=2)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    model = pii.train(docs, "text")
    return _recounted(pii.redact(docs, "text", model))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row per piece of a document, with its ids."""
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("pii", pii_redaction),
    ("packing", packing_stage),
]

# Models and fingerprints are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Every stage is written and read again; a stage's table is dropped
    once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        docs = spark.read.parquet(path)
        if before:
            drop_table(spark, before)
        before = path
    return docs
