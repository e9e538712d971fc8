"""Delimited files with quoted line breaks, read in splits.

Spark's own multi-line reader takes a file as one task.  Here the files are read as plain
lines, so that a large one is many splits.  Whether a line stands inside quotes depends on
the lines before it, but each line is only one of four steps on that state: it leaves it,
turns it, opens or closes.  Steps are put together first within each split, then over the
splits of a file (one row a split), and every line learns its state from the two.  Lines
that are a record of their own, nearly all, pass on as they are; only the lines of a record
with line breaks are gathered, by record.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanlake.session import staged

_QUOTED = '(^|,)"(?:[^"]|"")*+"'
_OPENED = '(^|,)"'
_CLOSING = '^(?:[^"]|"")*+"'


def _ends_inside(line: Column) -> Column:
    """Whether a line that begins outside quotes ends inside: a field opens that does not close."""
    return F.regexp_replace(line, _QUOTED, "$1x").rlike(_OPENED)


def with_steps(lines: DataFrame) -> DataFrame:
    """Add `from_out` and `from_in`: the state (1 inside quotes) after a line, by the state before it."""
    quoted = F.col("line").contains('"')
    closes = F.col("line").rlike(_CLOSING)
    after = F.concat(F.lit("x"), F.regexp_replace("line", _CLOSING, ""))
    return lines.withColumns({
        "from_out": F.when(quoted, _ends_inside(F.col("line"))).otherwise(F.lit(False)).cast("int"),
        "from_in": F.when(quoted & closes, _ends_inside(after)).otherwise(F.lit(True)).cast("int"),
    })


def with_relative_state(rows: DataFrame, parts: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add `fixed` and `turns`: the state before a row, relative to the start of its part.

    Before the row the state is `fixed` turned `turns` times, or, where `fixed` is NULL, the
    part's first state turned that often.  `rows` has the steps from_out and from_in.
    """
    upto = W.partitionBy(*parts).orderBy(*order)
    before = upto.rowsBetween(W.unboundedPreceding, -1)
    turn = ((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("int")
    sure = F.col("from_out") == F.col("from_in")
    counted = rows.withColumn("_turns", F.sum(turn).over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = F.last(F.when(sure, F.struct(F.col("from_out").alias("state"), F.col("_turns").alias("at"))), ignorenulls=True).over(before)
    seen = F.coalesce(F.lag("_turns").over(upto), F.lit(0))
    return counted.withColumn("_last", last).withColumns({
        "fixed": F.col("_last.state"), "turns": seen - F.coalesce(F.col("_last.at"), F.lit(0)),
    }).drop("_turns", "_last")


def _turned(state: Column, turns: Column) -> Column:
    return (state + turns) % 2


def _stepped(state: Column) -> Column:
    return F.when(state == 1, F.col("from_in")).otherwise(F.col("from_out"))


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source_file, record_no, record): the records of delimited files; empty lines are none.

    The first record of a file, its header, has the number 0.  Line breaks inside quotes
    become single line feeds.  A quote that is never closed takes the rest of its file.
    """
    text = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", r"^\x{FEFF}|\r$", "").alias("line"))
    split = ["source_file", "block"]
    lines = with_relative_state(with_steps(text), split, ["seq"])
    before = lambda first: _turned(F.coalesce(F.col("fixed"), first), F.col("turns"))
    both = lines.withColumns({"_out": before(F.lit(0)), "_in": before(F.lit(1))})
    starts = lambda c: ((F.col(c) == 0) & (F.col("line") != "")).cast("int")
    # one row a split: its step as a whole, and how many records begin in it, by its first state
    steps = both.groupBy(*split).agg(
        F.max_by(F.struct(_stepped(F.col("_out")).alias("o"), _stepped(F.col("_in")).alias("i")), "seq").alias("_s"),
        F.sum(starts("_out")).alias("_n0"), F.sum(starts("_in")).alias("_n1"),
    ).select(*split, F.col("_s.o").alias("from_out"), F.col("_s.i").alias("from_in"), "_n0", "_n1")
    firsts = with_relative_state(steps, ["source_file"], ["block"]).withColumn("first", before(F.lit(0)))
    began = F.when(F.col("first") == 1, F.col("_n1")).otherwise(F.col("_n0"))
    earlier = W.partitionBy("source_file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    firsts = firsts.select(*split, "first", F.coalesce(F.sum(began).over(earlier), F.lit(0)).alias("_records"))
    placed = lines.join(firsts, split).withColumn("_state", before(F.col("first")))
    placed = placed.withColumn("_ends", _stepped(F.col("_state")))
    within = W.partitionBy(*split).orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = placed.withColumn("record_no", F.col("_records") + F.sum(starts("_state")).over(within) - 1)
    numbered = numbered.filter((F.col("_state") == 1) | (F.col("line") != ""))
    whole = (F.col("_state") == 0) & (F.col("_ends") == 0)
    pieces = numbered.filter(~whole).groupBy("source_file", "record_no").agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "line"))).alias("_l"))
    return numbered.filter(whole).select("source_file", "record_no", F.col("line").alias("record")).unionByName(
        pieces.select("source_file", "record_no", F.array_join("_l.line", "\n").alias("record")))


def header_names(record: str) -> list[str]:
    """Column names of a header record: unnamed ones by place, repeated ones by name and place."""
    cells = next(csv.reader(io.StringIO(record)), [])
    low = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def parse_records(records: DataFrame) -> DataFrame:
    """Columns of records by their own file's header, beside source_file and record_no (from 1).

    All headers are found in one job, which returns each distinct one once.  The columns
    are those of all headers in the order in which the headers sort by their first file.
    """
    spark = records.sparkSession
    heads = records.filter("record_no = 0")
    known = heads.groupBy("record").agg(F.min("source_file").alias("f")).orderBy("f").collect()
    if not known:
        raise ValueError("no scan file has a header")
    headers = {r["record"]: header_names(r["record"]) for r in known}
    names = list(dict.fromkeys(n for h in headers.values() for n in h))
    width = max(map(len, headers.values()))
    places = spark.createDataFrame(
        [(r, [h.index(n) if n in h else None for n in names]) for r, h in headers.items()], "record string, _at array<int>")
    at = heads.join(places, "record").select("source_file", "_at")
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), {"escape": '"'})
    rows = records.filter("record_no > 0").withColumn("_c", cells)
    rows = rows.withColumn("_v", F.array(*[F.col(f"_c.c{i}") for i in range(width)])).join(at, "source_file")
    value = lambda j: F.get("_v", F.get("_at", F.lit(j)))
    return rows.select(*[value(j).alias(n) for j, n in enumerate(names)], "source_file", "record_no")


def read_delimited(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of delimited files with headers; every column is a string."""
    return parse_records(staged(read_records(spark, paths), "records"))
