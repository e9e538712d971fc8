"""Session helpers: settings, reliable checkpoints, staged tables, expressions evaluated once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HUGE_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def tune(spark: SparkSession) -> SparkSession:
    """Settings the rule ladders rely on, where the session leaves the default.

    HotSpot does not compile methods over 8000 bytes of byte code; a long ladder in
    one whole-stage method would run interpreted.  With this limit Spark splits such
    stages into small compiled methods instead.
    """
    if spark.conf.get(HUGE_METHOD_LIMIT) == "65535":
        spark.conf.set(HUGE_METHOD_LIMIT, "8000")
    return spark


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A filter on a projected column is pushed below the projection with the column's
    expression substituted into it, which would run a rule ladder twice.  Filters do
    not pass a generator, so the projected values are handed through a one-element
    `inline`.
    """
    hidden = df.withColumns({"_once_" + n: c for n, c in columns.items()})
    row = F.struct(*[F.col("_once_" + n).alias(n) for n in columns])
    return hidden.select(*df.columns, F.inline(F.array(row)))


def barrier(df: DataFrame) -> DataFrame:
    """The same rows, with filters above kept from being rewritten into the projection."""
    return df.select(F.inline(F.array(F.struct("*"))))


def spread(df: DataFrame) -> DataFrame:
    """Fan a scan with fewer partitions than cores out over the cores.

    Large inputs have more partitions than cores and are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session; one machine's temporary folder only in a local session."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (spark.sparkContext.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="scanlake-ckpt-"))


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint so that later passes read the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STAGED: dict[str, list[str]] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Like a checkpoint it cuts the lineage and survives lost executors; unlike one it is
    columnar, so that each later step reads only the columns and rows it needs.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Remove this session's staged tables, once nothing reads them any more; returns their number."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(p)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
