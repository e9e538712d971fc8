"""Line de-duplication: segment-partition edit join over lines, DataFrame functions only.

A line goes if an equal line stands earlier (ids in ascending order, then lines in order),
or one within EDITS edits does.  A line shorter than SHORT characters is only compared for
equality: few edits would turn it into any other.  Blank lines stay.

1. Equal lines are found by a grouped minimum over 128-bit hashes; only each line's first
   occurrence goes on.
2. Two lines within EDITS edits share one of EDITS + 1 segments: every line is cut into
   that many even segments, filed under (length, segment number, content).  A line looks up
   its own substrings for partner lengths from its own down to EDITS less, at the few places
   where a segment can stand (multi-match-aware selection).  At two edits these are 12
   keys; 3 of them are the line's own segments, which are filed already and not sent again.
3. Most keys are rare, and the lines that meet there are candidates.  A key that more than
   HOT lines are filed under (many variants of one line) would make pairs without end: its
   lines are joined with their texts instead, by semi joins, which stop at a line's first
   earlier partner and put out at most the lines themselves.
4. Candidates are verified by Spark's `levenshtein` with a threshold, which computes the
   band around the diagonal alone.  (Its inner step is not bit-parallel: SQL functions have
   no wide bit vectors, and an aggregate over characters would cost more than the band.)

Null texts stay null, empty ones empty.  A text whose lines all go becomes empty; no row
goes.  Rows equal in id and text are one document and get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import content_key, stage, whole_text

EDITS = 2
SHORT = 32
HOT = 16


def segment(length: Column, i: int, parts: int = EDITS + 1) -> tuple[Column, Column]:
    """(first place from 1, size) of segment i (from 0) of a line: the last ones take the remainder."""
    base = F.floor(length / parts)
    longer = parts - length % parts  # segments from here on have one character more
    start = base * i + F.greatest(F.lit(i) - longer, F.lit(0)) + 1
    size = base + F.when(F.lit(i) >= longer, 1).otherwise(0)
    return start.cast("int"), size.cast("int")


def segment_keys(line: Column) -> list[Column]:
    """Keys a line is filed under."""
    n = F.length(line)
    out = []
    for i in range(EDITS + 1):
        start, size = segment(n, i)
        out.append(F.xxhash64(n, F.lit(i), F.substring(line, start, size)))
    return out


def probe_keys(line: Column) -> list[Column]:
    """Keys a line looks up besides its own segments: substrings that a partner of no greater length may have as a segment."""
    n, out = F.length(line), []
    for less in range(EDITS + 1):
        own = n - less
        for i in range(EDITS + 1):
            start, size = segment(own, i)
            for shift in range(max(-i, less - (EDITS - i)), min(i, less + (EDITS - i)) + 1):
                if less or shift:
                    out.append(F.xxhash64(own, F.lit(i), F.substring(line, start + shift, size)))
    return out


def pick(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The lines at `places` (k, pos and more columns) of the texts: those columns and line."""
    more = [c for c in places.columns if c != "k"]
    per_text = places.groupBy("k").agg(F.collect_list(F.struct(*more)).alias("at"))
    lines = docs.join(per_text, "k").select("k", "at", F.split("text", "\n").alias("lines"))
    took = F.transform("at", lambda x: F.struct(*[x[c].alias(c) for c in more], F.element_at(F.col("lines"), x["pos"] + 1).alias("line")))
    return lines.select("k", F.inline(took))


def near_lines(d: DataFrame, first: DataFrame) -> DataFrame:
    """k, pos of the lines that have an earlier line within EDITS edits; d: (k, text), first: first occurrences."""
    some = pick(d, first.filter(F.col("n") >= SHORT).select("k", "pos", "id"))
    # the keys are made once; all that follows reads them from files
    keys = stage(some.select("id", F.array(*segment_keys(F.col("line"))).alias("filed"), F.array_distinct(F.array(*probe_keys(F.col("line")))).alias("asked")), "keys")
    filed, asked = keys.select("id", F.explode("filed").alias("key")), keys.select(F.col("id").alias("by"), F.explode("asked").alias("key"))
    hot = stage(filed.groupBy("key").agg(F.count("*").alias("lines")).filter(F.col("lines") > HOT).select("key"), "hot_keys")
    rare = filed.join(hot, "key", "left_anti")
    met = rare.join(asked, "key").filter("id <> by").union(rare.join(rare.withColumnRenamed("id", "by"), "key").filter("id < by"))
    pairs = stage(met.select(F.least("id", "by").alias("a"), F.greatest("id", "by").alias("b")).distinct(), "pairs")

    def with_text(ids: DataFrame) -> DataFrame:
        return pick(d, first.join(ids, "id").select("k", "pos", "id", "doc_id")).distinct()

    def side(texts: DataFrame, p: str) -> DataFrame:
        return texts.select(F.col("id").alias(p), F.struct("doc_id", "k", "pos").alias(f"{p}_at"), F.col("line").alias(f"{p}_line"), F.length("line").alias(f"{p}_n"))

    close = F.levenshtein("a_line", "b_line", EDITS).between(0, EDITS)
    texts = with_text(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    near = pairs.join(side(texts, "a"), "a").join(side(texts, "b"), "b").filter(close).select("a_at", "b_at")
    filed_hot = stage(filed.join(hot, "key"), "hot_filed")
    asked_hot = stage(asked.join(hot, "key").select("by", "key"), "hot_asked").union(filed_hot.select(F.col("id").alias("by"), "key"))
    hot_texts = with_text(filed_hot.select("id").union(asked_hot.select("by")).distinct())
    left, right = filed_hot.withColumnRenamed("id", "a").join(side(hot_texts, "a"), "a"), asked_hot.withColumnRenamed("by", "b").join(side(hot_texts, "b"), "b")
    same_key = left["key"] == right["key"]
    # a filed line is never longer than the one that asks; two equally long ones ask each other, so the later one asks
    near_asking = right.join(left, same_key & (left["a_at"] < right["b_at"]) & close, "left_semi").select(F.col("b_at").alias("g"))
    near_filed = left.join(right, same_key & (right["b_at"] < left["a_at"]) & (left["a_n"] < right["b_n"]) & close, "left_semi").select(F.col("a_at").alias("g"))
    return near.select(F.greatest("a_at", "b_at").alias("g")).union(near_asking).union(near_filed).select("g.k", "g.pos").distinct()


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """k (content key of a row), n_lines, n_kept, kept (the lines that stay)."""
    d = docs.select(content_key(F.col(id_col), F.col(text)).alias("k"), F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    lines = d.select("k", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    seen = lines.filter(F.trim("line") != "").groupBy(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(17), "line").alias("id2"))
    first = stage(seen.agg(F.min(F.struct("doc_id", "k", "pos")).alias("f"), F.min(F.length("line")).alias("n")).select("id", "f.doc_id", "f.k", "f.pos", "n"), "lines")
    # hot keys and pairs are plans of their own, so that none grows beyond the driver's memory
    d = d.select("k", "text")
    stays = first.select("k", "pos").join(near_lines(d, first), ["k", "pos"], "left_anti")
    keep = stays.groupBy("k").agg(F.collect_set("pos").alias("keep"))
    every = F.split("text", "\n")
    rows = d.join(keep, "k", "left").select("k", every.alias("lines"), "keep")
    blank = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    at = F.array_sort(F.concat(F.coalesce("keep", F.array().cast("array<int>")), blank))
    rows = rows.select("k", "lines", at.alias("at")).select(
        "k", F.size("lines").alias("n_lines"), F.size("at").alias("n_kept"), F.array_join(F.transform("at", lambda p: F.element_at(F.col("lines"), p + 1)), "\n").alias("kept"))
    return rows.dropDuplicates(["k"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their columns; the text holds the lines that stay."""
    kept = kept_texts(docs, id_col, text)
    other = [c for c in docs.columns if c != text]
    rows = docs.select(*other, F.col(text).isNull().alias("_null"), content_key(F.col(id_col), F.col(text)).alias("_k"))
    rows = rows.join(kept.withColumnRenamed("k", "_k").withColumnsRenamed({"n_lines": "_lines", "n_kept": "_kept", "kept": "_text"}), "_k")
    whole = F.when(~F.col("_null"), F.col("_text")).alias(text)
    return rows.select(*[whole if c == text else F.col(c) for c in docs.columns], F.col("_lines").alias("n_lines"), F.col("_kept").alias("n_kept"))
