"""Scan texts: noise and repeat removal, boundaries, chunks.

A text is one row, so its lines are worked on as an array inside the row: no line
is shuffled, and the text is never taken apart across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.text import or_empty, split_lines, strip, words
from scanlake.session import once
from scanlake.tables import fixed

NOISE = "(?i)" + "|".join(f"(?:{p})" for p in fixed.NOISE_PATTERNS)
BOUNDARY = "(?i)" + "|".join(f"(?:{p})" for p in fixed.BOUNDARY_PATTERNS)


def is_noise(stripped: Column) -> Column:
    return (F.length(stripped) < 4) | stripped.rlike(NOISE)


def is_boundary(line: Column) -> Column:
    return line.rlike(BOUNDARY)


def clean_texts(docs: DataFrame) -> DataFrame:
    """Drop noise lines and repeated lines, squeeze runs of blank lines.

    A line is a repeat when an earlier line equals it without regard to case and
    outer blanks.  Sorting (line, place) once per text finds first occurrences in
    n log n.  A blank line stays when the line before it in the input is not blank.
    """
    staged = docs.withColumn("_lines", split_lines(F.col("text"))).withColumn(
        "_m", F.transform("_lines", lambda x: strip(x))
    )
    keyed = F.transform(
        "_m", lambda s, i: F.struct(F.lower(s).alias("k"), i.alias("i"), s.alias("s"))
    )
    staged = staged.withColumn("_sorted", F.array_sort(
        F.transform(
            F.filter(keyed, lambda e: (e["s"] != "") & ~is_noise(e["s"])),
            lambda e: F.struct(e["k"].alias("k"), e["i"].alias("i")),
        )
    ))
    firsts = F.filter(
        "_sorted",
        lambda e, j: (j == 0) | (e["k"] != F.get(F.col("_sorted"), j - 1)["k"]),
    )
    blanks = F.filter(
        F.transform("_m", lambda s, i: F.when(s == "", i)),
        lambda i: i.isNotNull() & ((i == 0) | (F.get(F.col("_m"), i - 1) != "")),
    )
    staged = staged.withColumn(
        "_keep", F.array_sort(F.concat(F.transform(firsts, lambda e: e["i"]), blanks))
    )
    kept = F.array_join(F.transform("_keep", lambda i: F.get(F.col("_lines"), i)), "\n")
    return once(staged.drop("text"), {"text": kept}).drop("_lines", "_m", "_sorted", "_keep")


def limit_words(docs: DataFrame, cleaned: DataFrame, max_words: int, key: str = "doc_id") -> DataFrame:
    """Single-shot input: the first `max_words` words of a cleaned text, with word counts."""
    before = docs.select(key, F.size(words(F.col("text"))).alias("words_before"))
    w = cleaned.withColumn("_w", words(F.col("text"))).withColumn("words_after", F.size("_w"))
    return w.join(before, key).withColumn(
        "text",
        F.when(F.col("words_after") > max_words,
               F.array_join(F.slice("_w", 1, max_words), " ")).otherwise(F.col("text")),
    ).withColumn("truncated", F.col("words_after") > max_words).drop("_w")


def with_boundaries(docs: DataFrame) -> DataFrame:
    """Add `_lines` and `_bounds`, the line numbers at which a finding seems to start."""
    staged = docs.withColumn("_lines", split_lines(F.col("text")))
    return staged.withColumn(
        "_bounds",
        F.filter(
            F.transform("_lines", lambda x, i: F.when(is_boundary(x), i)),
            lambda i: i.isNotNull(),
        ),
    )


def word_chunk_size(n: Column) -> Column:
    """max(800, words // max(1, words // 2000))"""
    parts = F.greatest(F.floor(n / 2000), F.lit(1))
    return F.greatest(F.lit(800), F.floor(n / parts)).cast("int")


def chunk_texts(docs: DataFrame, per_chunk: int = 6, key: str = "doc_id") -> DataFrame:
    """(doc, chunk_no, chunk): every `per_chunk` boundaries open a chunk; a text with
    fewer than three boundaries is cut by word count instead.

    Text before the first boundary belongs to no chunk.
    """
    staged = (
        with_boundaries(docs)
        .withColumn("_starts", F.filter("_bounds", lambda b, j: j % per_chunk == 0))
        .withColumn("_w", F.when(F.size("_bounds") < 3, words(F.col("text"))))
        .withColumn("_size", word_chunk_size(F.size("_w")))
    )
    by_bound = F.transform(
        "_starts",
        lambda s, j: strip(F.array_join(
            F.slice(
                F.col("_lines"), s + 1,
                F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_lines")) - s,
            ), "\n")),
    )
    by_words = F.when(
        F.size("_w") > 0,
        F.transform(
            F.sequence(F.lit(0), F.size("_w") - 1, F.col("_size")),
            lambda i: F.array_join(F.slice(F.col("_w"), i + 1, F.col("_size")), " "),
        ),
    )
    chunks = F.filter(
        F.when(F.size("_bounds") >= 3, by_bound).otherwise(by_words), lambda c: c != ""
    )
    whole = F.when(F.coalesce(F.size(chunks), F.lit(0)) > 0, chunks).otherwise(
        F.array(or_empty(F.col("text")))
    )
    # Exploding the expression itself: for a plain column Spark would add a size filter
    # and push it, with everything the column is made of, down to the scan.
    return staged.select(
        key, (F.size("_bounds") >= 3).alias("by_boundary"),
        F.posexplode(whole).alias("chunk_no", "chunk"),
    )


def estimate_chunks(docs: DataFrame, per_chunk: int = 6, key: str = "doc_id") -> DataFrame:
    """Number of chunks without cutting."""
    staged = with_boundaries(docs).withColumn("_n", F.size(words(F.col("text"))))
    by_words = F.ceil(F.col("_n") / word_chunk_size(F.col("_n")))
    by_bound = F.ceil(F.size("_bounds") / per_chunk)
    return staged.select(
        key,
        F.size("_bounds").alias("boundaries"),
        F.greatest(
            F.lit(1), F.when(F.size("_bounds") < 3, by_words).otherwise(by_bound)
        ).cast("int").alias("chunks"),
    )
