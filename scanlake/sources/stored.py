"""Keyed tables on disk: bucket folders of sorted Parquet, upserts of touched buckets, point reads.

A row lives in the folder `_bucket=n` that the hash of its key names, sorted by its key and
with a bloom filter on each key column.  A read of one key therefore opens one folder and
skips the row groups that cannot hold it; an upsert rewrites only the folders that its keys
fall into, in one dynamic partition overwrite, which replaces a folder when all its files
are complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.operators.history import upsert

BUCKETS = 64
BUCKET = "_bucket"


def bucket_of(keys: Sequence[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _layout(path: str) -> str:
    return f"{path}/_layout"  # readers pass over names that begin with an underscore


def layout(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """(key columns, number of buckets) of a stored table."""
    row = spark.read.schema("keys array<string>, buckets int").json(_layout(path)).first()
    return row["keys"], row["buckets"]


def _write(df: DataFrame, path: str, keys: Sequence[str], buckets: int, mode: str) -> None:
    placed = df.withColumn(BUCKET, bucket_of([F.col(k) for k in keys], buckets))
    writer = (
        placed.repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, *keys)
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET)
    )
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    writer.parquet(path)


def create_table(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Store rows with unique keys at a new path."""
    _write(df, path, keys, buckets, "errorifexists")
    df.sparkSession.createDataFrame([(list(keys), buckets)], "keys array<string>, buckets int").coalesce(1).write.json(_layout(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def lookup_key(spark: SparkSession, path: str, *key: object) -> DataFrame:
    """The row with this key: one bucket is listed and read, and the filter reaches the scan."""
    keys, buckets = layout(spark, path)
    rows = spark.read.parquet(path)
    values = [F.lit(v).cast(rows.schema[k].dataType) for k, v in zip(keys, key, strict=True)]
    # the bucket is a number here, so that the folders are pruned while planning
    place = spark.range(1).select(bucket_of(values, buckets)).first()[0]
    rows = rows.filter(F.col(BUCKET) == place)
    for k, v in zip(keys, key, strict=True):
        rows = rows.filter(F.col(k) == F.lit(v))
    return rows.drop(BUCKET)


def lookup_keys(wanted: DataFrame, path: str) -> DataFrame:
    """Rows of many keys: a semi join in which both sides carry their bucket.

    The folders to read are pruned by the buckets that the wanted keys fall into.
    """
    spark = wanted.sparkSession
    keys, buckets = layout(spark, path)
    asked = wanted.select(*keys).distinct().withColumn(BUCKET, bucket_of([F.col(k) for k in keys], buckets))
    touched = [r[0] for r in asked.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
    rows = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched))
    return rows.join(asked, [BUCKET, *keys], "left_semi").drop(BUCKET)


def upsert_table(updates: DataFrame, path: str, version: str) -> list[int]:
    """Last write wins per key, in place; returns the buckets that were rewritten.

    Only the touched folders are read, merged and replaced.  Columns that only one side
    has are NULL on the other; new columns widen the rows of touched folders, and older
    folders read as NULL there.
    """
    spark = updates.sparkSession
    keys, buckets = layout(spark, path)
    touched = sorted(r[0] for r in updates.select(bucket_of([F.col(k) for k in keys], buckets)).distinct().collect())
    if not touched:
        return []
    old = spark.read.option("mergeSchema", "true").parquet(path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    _write(upsert(old, updates, keys, version), path, keys, buckets, "overwrite")
    return touched
