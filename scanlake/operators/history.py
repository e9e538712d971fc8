"""Run history, run-log events and key look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.text import not_blank, or_empty, strip


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write wins per key: the row with the highest `version`, updates on ties.

    One aggregation with partial results per task, so a key written many times does
    not gather its rows.
    """
    both = target.withColumn("_new", F.lit(0)).unionByName(
        updates.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.col("_new"))).alias("_r"))
        .select(*keys, "_r.*")
    )


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write the merged table to a new path; plain files have no in-place merge."""
    df.write.mode("errorifexists").parquet(path)


def coerce_history(df: DataFrame) -> DataFrame:
    """Fill defaults; findings fall back to those of the analysis, the count to their number."""
    own = F.col("findings")
    if "analysis_data" in df.columns:
        own = F.coalesce(own, F.col("analysis_data.findings"))
    have = set(df.columns)
    text = lambda c: strip(or_empty(F.col(c))) if c in have else F.lit("")
    named = F.coalesce(not_blank(text("input_name")), text("source_file"))
    path = F.coalesce(not_blank(text("report_path")), text("output_path"))
    return df.withColumns({
        "findings": own,
        "date": F.col("date").cast("string") if "date" in have else F.lit(""),
        "input_name": named,
        "source_file": text("source_file"),
        "file_name": text("file_name"),
        "report_path": path,
        "log_path": text("log_path"),
        "finding_count": F.coalesce(
            F.col("finding_count").cast("long"),
            F.greatest(F.coalesce(F.size(own), F.lit(0)), F.lit(0)).cast("long"),
        ),
    }).withColumn("date", or_empty(F.col("date")))


def list_history(df: DataFrame) -> DataFrame:
    """Newest first; entries without a date last."""
    return df.orderBy((F.col("date") == "").asc(), F.col("date").desc(), F.col("id").desc())


def norm_id(key: str, prefix: str = "") -> str:
    """Upper-case id with its catalog prefix."""
    k = key.strip().upper()
    return k if not prefix or k.startswith(prefix) else prefix + k


def get_by_key(df: DataFrame, key: str, prefix: str = "", column: str = "id") -> DataFrame:
    """Point look-up; the filter reaches the parquet scan."""
    return df.filter(F.col(column) == F.lit(norm_id(key, prefix)))


def list_family(controls: DataFrame, family: str) -> DataFrame:
    return controls.filter(F.col("family") == family.strip().upper()).orderBy("id")


def append_events(df: DataFrame, path: str) -> None:
    """Append run-log events (run_id, timestamp, type, data), one folder per type."""
    df.write.mode("append").partitionBy("type").parquet(path)


def interaction_event(row: dict[str, Column]) -> Column:
    """The ten-field data record of an interaction event, as JSON."""
    fields = [
        "label", "task_type", "attempt", "provider", "model", "request_payload",
        "user_content_original", "user_content_sent", "response_received_raw",
        "response_restored",
    ]
    return F.to_json(F.struct(*[
        (row[f] if f in row else F.lit("")).alias(f) for f in fields
    ]))
