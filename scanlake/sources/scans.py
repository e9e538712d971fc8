"""Scan exports and scan texts as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.functions.text import split_lines
from scanlake.sources.records import read_delimited
from scanlake.tables import fixed


#: A row id is (scan, file, row): so many bits for the row of a file and the file of a scan.
ROW_BITS, FILE_BITS, SCAN_BITS = 33, 20, 10


def scan_files(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The files behind the paths in the order of the paths, those of one path by name; lists them, reads nothing."""
    files: dict[str, None] = {}
    for given in [paths] if isinstance(paths, str) else paths:
        files.update(dict.fromkeys(sorted(spark.read.text(given).inputFiles())))
    # the metadata column writes local paths with one slash
    return [re.sub("^file:/+", "file:/", f) for f in files]


def read_scan_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Delimited scan exports, each read by its own header; every column is a string.

    A large file is read in many splits, line breaks in quoted cells included, and the
    headers of all files are found in one job.  `source_file` and a unique `row_id` that
    follows the order of the files as given, then that of the rows, are added.
    """
    files = scan_files(spark, paths)
    if len(files) > 1 << FILE_BITS:
        raise ValueError(f"a scan may have at most {1 << FILE_BITS} files")
    places = spark.createDataFrame([(uri, i << ROW_BITS) for i, uri in enumerate(files)], "source_file string, _file long")
    rows = read_delimited(spark, [paths] if isinstance(paths, str) else list(paths))
    columns = [f"`{c}`" for c in rows.columns[:-2]]
    return rows.join(places, "source_file").select(
        *columns, "source_file", (F.col("_file") + F.col("record_no") - 1).alias("row_id"))


def _stacked(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_scans(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack scans with different headers; absent columns become NULL.

    Where every frame is a scan with a `row_id`, the ids stay unique and follow the order of
    the frames: the number of the frame goes before them.
    """
    frames = list(frames)
    if len(frames) > 1 and all("row_id" in f.columns for f in frames):
        if len(frames) > 1 << SCAN_BITS:
            raise ValueError(f"at most {1 << SCAN_BITS} scans can be stacked")
        frames = [
            f.withColumn("row_id", F.col("row_id").cast("long") + F.lit(i << (ROW_BITS + FILE_BITS)))
            for i, f in enumerate(frames)
        ]
    return _stacked(frames)


def selected_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """Logical column -> actual header: the first in *file* order that is an alias."""
    clean = [(c, c.strip().lower()) for c in columns]
    return {
        logical: next((actual for actual, low in clean if low in aliases), None)
        for logical, aliases in fixed.HEADER_ALIASES.items()
    }


def resolve_columns(df: DataFrame, keep: Sequence[str] = ("row_id", "report_id")) -> DataFrame:
    """Rename a scan to the logical columns; absent ones are NULL strings.

    Raises ValueError when no column can serve as the finding name.
    """
    chosen = selected_columns(df.columns)
    if chosen["name"] is None:
        raise ValueError("the scan has no 'Name' or 'Plugin Name' column")
    cols = [
        (F.col(f"`{actual}`").cast("string") if actual else F.lit(None).cast("string"))
        .alias(logical)
        for logical, actual in chosen.items()
    ]
    return df.select(*[c for c in keep if c in df.columns], *cols)


def read_scan_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per text file: doc_id (the path) and its whole text."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every text."""
    return docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
