"""A training corpus from documents: quality, near duplicates, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The stages
are written as Parquet between each other, by run() as tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontamination, jaccard_join, privacy, quality, sentencepiece_codec
from graphloom.llm.common import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, apply) -> DataFrame:
    """docs with new texts. The operators carry one key column through, so the other columns travel inside it."""
    packed = docs.select(F.struct("doc_id", "lang", "source", F.xxhash64("doc_id", "text").alias("mark")).alias("row"), "text")
    out = apply(packed)
    return out.select("row.doc_id", "text", "row.lang", "row.source", F.length("text").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field takes for good."""
    field = quality.train(docs, table(spark, sf_dir, "labels"), F.expr(f"not {quality.HELD_OUT}"))
    return quality.quality_scores(docs.select(*COLUMNS), field).where("score >= 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates: 0.8 of their five-word shingles are shared."""
    return jaccard_join.keep_one(docs.select(*COLUMNS), n=5, percent=80).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    bench = table(spark, sf_dir, "benchmark")
    return _with_text(docs, lambda d: decontamination.decontaminate(d, bench, key="row"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it become their kind."""
    return _with_text(docs, lambda d: privacy.sanitise(d, key="row"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    packed = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    return sentencepiece_codec.encode(packed, key="row").select("row.doc_id", "row.lang", "row.source", F.col("ids").alias("input_ids"), F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii_sanitisation", privacy_stage),
    ("sentencepiece", token_stage),
]

#: SQL can express neither the field nor the tokenizer; tests of run() are of ids, lengths and stages on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
