"""Keyword rules as a table: the first rule whose keyword a text contains, as a join.

A 'contains' condition has no join key.  Keywords are filed under their heads, the first HEAD
characters (shorter keywords under themselves), with the lengths that keywords of a head have.
A text asks at each position with the characters there; where a head meets, the stretches of
the filed lengths are cut out of the text and joined with the keywords by equality.  So a text
costs its length once, whatever the keywords have in common, and what is shuffled are the few
stretches that begin like a keyword.  Both tables may be of any size: no row is collected,
and no broadcast is forced (the heads are few, so Spark broadcasts them by itself).  Many
keywords are never broadcast: Spark judges them by the compressed size of their file, which
says little of the rows that the driver would have to hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanlake.session import staged

HEAD = 4
#: Texts are walked in blocks, because the n-th character is found by counting.
BLOCK = 128
#: Stretches of one keyword are dealt to so many tasks.
SALTS = 8
#: Of more keywords than this, none is sent to the driver.
FEW = 10_000


def first_rules(rules: DataFrame) -> DataFrame:
    """(keyword, ordinal, label): of equal keywords the first rule; empty and NULL ones match nothing."""
    return rules.filter(F.col("keyword") != "").groupBy("keyword").agg(
        F.min_by(F.struct("ordinal", "label"), "ordinal").alias("_r")).select("keyword", "_r.ordinal", "_r.label")


def keyword_heads(rules: DataFrame) -> DataFrame:
    """(head, lengths): hashes of the first HEAD characters of keywords, and how long these keywords are."""
    return rules.filter(F.col("keyword") != "").groupBy(
        F.xxhash64(F.substring("keyword", 1, HEAD)).alias("head")).agg(F.collect_set(F.length("keyword")).alias("lengths"))


def text_heads(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(_key, _text, _pos, head): hashes of the stretches at each position of a text that may be heads.

    Heads have few sizes.  A position asks for all of them if its first characters, as many
    as the shortest head has, begin one.
    """
    # one row for each of the HEAD possible sizes at most
    size = F.least(F.length("keyword"), F.lit(HEAD))
    sizes = sorted(r[0] for r in rules.filter(F.col("keyword") != "").select(size).distinct().collect()) or [HEAD]
    rows = texts.filter(F.col(key).isNotNull() & (F.col(text) != "")).select(
        F.col(key).alias("_key"), F.col(text).alias("_text"))
    block = lambda at: F.struct(
        at.alias("at"), F.substring(F.col("_text"), at, F.lit(BLOCK + HEAD - 1)).alias("chars"))
    blocks = rows.select("_key", "_text", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("_text"), F.lit(BLOCK)), block)).alias("_b"))
    chars, i = F.col("_b.chars"), F.col("_i")
    asked = blocks.select("*", F.explode(F.sequence(F.lit(1), F.least(F.length(chars), F.lit(BLOCK)))).alias("_i"))
    begin = lambda n: F.xxhash64(F.substring(chars, i, F.lit(n)))
    asked = asked.withColumn("head", begin(sizes[0]))
    if len(sizes) > 1:
        starts = staged(rules.filter(F.col("keyword") != "").select(
            F.xxhash64(F.substring("keyword", 1, sizes[0])).alias("head")).distinct(), "keyword_starts")
        asked = asked.join(starts, "head", "left_semi").withColumn(
            "head", F.explode(F.array_distinct(F.array(*[begin(n) for n in sizes]))))
    return asked.select("_key", "_text", (F.col("_b.at") + i - 1).alias("_pos"), "head")


def text_hits(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, ordinal, keyword, label), one row for each row of `texts` and each keyword it contains."""
    filed = staged(first_rules(rules), "keyword_rules")
    heads = staged(keyword_heads(filed), "keyword_heads")
    met = text_heads(texts, key, text, filed).join(heads, "head").select(
        "_key", "_text", "_pos", F.explode("lengths").alias("_n"))
    cut = met.withColumn("keyword", F.substring(F.col("_text"), F.col("_pos"), F.col("_n")))
    # a keyword counts once for a text, where it stands first
    first = cut.filter((F.length("keyword") == F.col("_n")) & (F.instr(F.col("_text"), F.col("keyword")) == F.col("_pos")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    asked = first.select("_key", "keyword", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).alias("_salt"))
    known = filed.withColumn("_salt", salts)
    known = known if filed.count() <= FEW else known.hint("merge")
    return asked.join(known, ["keyword", "_salt"]).select(
        F.col("_key").alias(key), "ordinal", "keyword", "label")


def rule_hits(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, ordinal, keyword, label) for every text and every keyword it contains.

    `rules` is (ordinal, keyword, label); `key` is unique and not NULL.  Should n texts of
    one key contain a keyword, each of them is paired with all n.
    """
    alike = W.partitionBy(key, "keyword")
    return text_hits(texts, key, text, rules).withColumn("_n", F.count("*").over(alike)).select(
        key, "ordinal", "keyword", "label", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).drop("_i")


def keyword_join(
    df: DataFrame, key: str, text: str, rules: DataFrame, name: str = "label"
) -> DataFrame:
    """Add the label of the first rule (by ordinal) whose keyword the text contains, else NULL.

    Rules with one ordinal are taken in the order of their keywords.
    """
    first = text_hits(df, key, text, rules).groupBy(key).agg(
        F.min_by("label", F.struct("ordinal", "keyword")).alias(name))
    return df.join(first, key, "left")
