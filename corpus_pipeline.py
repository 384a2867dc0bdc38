"""Corpus pipeline: language ID, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a
DataFrame that is written as parquet and read again as the next one's ``docs``. All stages but the
last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import chunks, langid, near_dup, packing, toxicity
from tracewright.llm.shared import work_dir, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; those without a letter, or whose likeliest language
    has a probability under one half, go. Learned from the labelled rows among ``docs``."""
    return langid.keep_identified(docs, langid.fit(docs.where(langid.learnable())))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.learnable())
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id. Documents without an
    id or without words all stay; so do rows that repeat a kept document's id."""
    folder = work_dir(spark)
    found = near_dup.near_duplicates(docs, folder)
    kept = written(found.where("kept").select(F.col("doc_id").alias("kept_id")).distinct(), folder, "kept")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of power-of-two lengths that the documents are cut into."""
    return packing.pack(docs, work_dir(spark), chunks.default_vocabulary(), end_id=1)


STAGES = [("language_id", identified), ("toxicity", clean), ("near_duplicates", distinct), ("packing", packed)]

#: No SQL expresses trained models, sketches or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"{k}-{name}")
    return docs
