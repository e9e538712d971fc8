"""The operators over the given tables: one query each, with production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm import (
    alignment, decontaminate, exact_dedup, fingerprints, language, line_dedup, lm, near_duplicates, packing, quality, runs, suffixes, toxicity,
)
from scanlake.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The file with the vocabulary; it is installed next to the interpreter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "copy_id", "class_id", "links", F.hex("class_key").alias("class_key"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "edits", "start", "length")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_kept", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def periodic_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words, made periodic from some word on in a tenth of the documents; a null id changes nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.collapse_runs(table(spark, sf_dir, "documents"), edit=periodic_tail))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_toxicity, op3_fingerprints, op4_near_duplicates, op5_language,
    op6_suffixes, op7_decontaminate, op8_lm_scores, op9_line_dedup, op10_quality, op11_alignment, op12_exact_dedup, op13_periodic_runs)}
#: The other results are not expressible as SQL that ends in time on whole tables; tests/llm compare with brute force.
ORACLE: dict[str, str] = {"op12_exact_dedup": exact_dedup.SQL}
