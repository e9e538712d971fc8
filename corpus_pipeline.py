"""The corpus pipeline: five stages over `documents`, each written and read again.

Quality classifier (rejected documents go), line de-duplication, near-duplicate join (one
document of a class stays), benchmark decontamination (documents with an item go), and
packing of what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanlake.llm import decontaminate, line_dedup, near_duplicates, packing, quality
from scanlake.llm.common import stage, table
from scanlake.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_first(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", unique_lines),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", no_benchmark),
    ("packing", packed),
]
#: The classifier and the joins are not expressible in SQL; tests/llm checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
