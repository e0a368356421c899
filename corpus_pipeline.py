"""From raw documents to packed sequences, in five stages.

``run`` applies STAGES to ``documents``; each stage's rows are written in the shared folder and read again for the next. Rows without
doc_id pass the filters, for nothing can be said about them by id; rows that share a doc_id stay or go together.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import decontaminate, jaccard, language, line_dedup, packing
from tallywright.llm.common import saved, table
from tallywright.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best language is one of the wanted ones."""
    found = language.identify(docs, "doc_id", declared="lang", host=F.col("source"))
    return docs.join(found.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, equal ones of any length and, from 40 characters, those within two edits; a document of nothing else goes. n_chars follows the text."""
    left = line_dedup.without_repeated_lines(docs, edits=2, least=40, exact=1)
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    found = jaccard.near_documents(docs, threshold=0.8, size=5)
    return docs.join(found.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: the place of every piece of every document."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1, size=4096)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Similarity, scoring and tokenizers are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
