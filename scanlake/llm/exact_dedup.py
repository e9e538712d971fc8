"""Exact de-duplication with a two-pass Bloom filter, DataFrame functions only.

Two texts are equal when they are identical without white space (`[\\x20\\x09-\\x0D]`).  Of
equal texts the row with the most code points stays, then the one with the smallest id
(null ids last), then the first one read.

Pass one sets BITS_ROW bits a row in a blocked filter: a row's hash names a block of 2^15
bits and SLOTS places in it.  Only the numbers of places travel, summed map-side; those
hit at least twice make the filter of repeats, a bit map a block.  Pass two looks every row
up: a row with a place that no other row hit has no equal and passes straight on, without
a shuffle.  The others (repeated rows, and about 2 % by chance) are grouped by
their SHA-256, so that the filter only ever saves work and never decides.

The filter grows with the rows up to BLOCKS_MOST blocks (128 MB), which bounds what is
broadcast; beyond that more rows are grouped by hash, with the same result.  Groups that hold
more than 1/HOT_SHARE of the rows are fewer than HOT_SHARE and reach their rows by a
broadcast; the other groups by a join.

Null texts count as empty; empty texts and those of white space alone equal each other.
Repeated rows are equal texts like any other; of rows that tie, exactly one stays.  Very
long texts are hashed where they are read; only hashes and, in `drop_copies`, rows that may
be repeated travel.  An empty table gives an empty result.  Columns of `docs` may have any
names: rows are carried in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import stage, whole_text

BLOCK = 1 << 15
BLOCKS_MOST = 1 << 15
BITS_ROW = 16
SLOTS = 2
HOT_SHARE = 1024
_SPACE = " \t\n\x0b\x0c\r"


def without_space(text: Column) -> Column:
    for c in _SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def text_sha(text: Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes."""
    return F.unhex(F.sha2(F.encode(without_space(text), "UTF-8"), 256))


def blocks_for(rows: int) -> int:
    return min(max(1, -(-rows * BITS_ROW // BLOCK)), BLOCKS_MOST)


def block_of(sha: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(blocks))


def places(sha: Column) -> list[Column]:
    """Places (0 .. BLOCK-1) of a row in its block."""
    h = F.xxhash64(sha, F.lit(1))
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK - 1)) for i in range(SLOTS)]


def repeat_filter(shas: DataFrame, blocks: int) -> DataFrame:
    """block, bits: places of the block that at least two rows hit; shas has the column sha."""
    hit = shas.select(block_of(F.col("sha"), blocks).alias("block"), F.explode(F.array_distinct(F.array(*places(F.col("sha"))))).alias("place"))
    twice = hit.groupBy("block", "place").agg(F.count("*").alias("hits")).filter("hits > 1")
    return twice.repartition("block").groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def maybe_repeated(rows: DataFrame, repeats: DataFrame, blocks: int) -> DataFrame:
    """Add `_again`: false where the row's sha certainly occurs once."""
    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1

    bits = F.broadcast(repeats.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))  # at most BLOCKS_MOST rows of 4 KB
    met = rows.join(bits, block_of(F.col("sha"), blocks) == F.col("_block"), "left")
    every = F.lit(True)
    for p in places(F.col("sha")):
        every = every & is_set(p)
    return met.select(*rows.columns, F.coalesce(every, F.lit(False)).alias("_again"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    whole = whole_text(text)
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.length(whole).alias("n"), text_sha(whole).alias("sha")), "hashes")
    total = rows.count()
    blocks = blocks_for(total)
    rows = maybe_repeated(rows, stage(repeat_filter(rows, blocks), "repeats"), blocks)
    alone = rows.filter("not _again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = rows.filter("_again")
    best = F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), "doc_id", "row")).alias("best")
    groups = stage(again.groupBy("sha").agg(best, F.count("*").alias("group_size")).select(
        "sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    is_hot = F.col("group_size") * HOT_SHARE > total
    hot, rest = F.broadcast(groups.filter(is_hot)), groups.filter(~is_hot)
    named = again.join(hot, "sha").unionByName(again.join(hot.select("sha"), "sha", "left_anti").join(rest, "sha"))
    named = named.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha")
    return alone.unionByName(named).withColumn("sha", F.lower(F.hex("sha"))).withColumnRenamed("sha", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their columns."""
    whole = whole_text(text)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.length(whole).alias("n"), text_sha(whole).alias("sha"))
    shas = stage(rows.select("sha"), "hashes")
    blocks = blocks_for(shas.count())
    rows = maybe_repeated(rows, stage(repeat_filter(shas, blocks), "repeats"), blocks)
    first = rows.filter("_again").groupBy("sha").agg(F.min_by("row", F.struct(-F.col("n"), F.col("id").isNull(), "id")).alias("row"))
    return rows.filter("not _again").select("row.*").union(first.select("row.*"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d),
r AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM e WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, i = 1 AS kept, text_sha256 FROM r
"""
