"""Helpers shared by the operators: shared storage, keys, samples, components, sorted runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_HELD: dict[str, Callable[[], None]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`.

    Where it is unset, a local session (one machine, as in tests) gets a temporary one;
    a cluster without it is an error, since executors could not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if named:
        return named
    if not (spark.sparkContext.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="scanlake-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    _LOCAL[spark.sparkContext.applicationId] = folder
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: later steps start from files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def content_key(id_col: Column, text: Column) -> Column:
    """16 bytes that stand for a row's id and text: rows equal in both share it, others do not."""
    known = F.coalesce(id_col.cast("string"), F.lit(""))
    kind = F.concat(id_col.isNull().cast("string"), text.isNull().cast("string"), F.length(known).cast("string"), F.lit(":"))
    return F.unhex(F.md5(F.concat(kind, known, F.coalesce(text.cast("string"), F.lit("")))))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """crc32 of the id as text leaves `rest` when divided by `mod`; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def smallest_by_hash(df: DataFrame, n: int, *by: str) -> DataFrame:
    """A fixed pseudo-random choice of about `n` rows (ties of the hash are kept together).

    Only the hashes are ranked; the rows are then found by a comparison in the scan.
    """
    h = F.xxhash64(*[F.col(c) for c in by])
    top = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.filter(h <= top) if top is not None else df.limit(0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node of each.

    Alternates the large-star and small-star steps; every step is a grouped minimum and a
    join, so no neighbourhood is gathered in one place.  Each round is written to the
    shared folder.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    e = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    last = None
    while True:
        sym = both(e)
        low = sym.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = sym.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(
            F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))
        ).filter("a <> b").distinct()
        e = stage(small, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def hold(owner: str, drop: Callable[[], None]) -> None:
    """Say that an operator keeps look-ups in this Python worker; those of other operators are dropped.

    Workers are used again by later stages, which need the memory for themselves.
    """
    for other in [o for o in _HELD if o != owner]:
        _HELD.pop(other)()
    _HELD[owner] = drop


def in_slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about `most` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        part = np.cumsum(np.diff(_offsets(b.column(text)))) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buf = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    return buf[column.offset: column.offset + len(column) + 1]


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, end to end, and the rows' borders in them."""
    off = _offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]: off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, (off - off[0]).astype(np.int64)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from batches sorted by them; small runs come many at a time."""
    held: list[pa.RecordBatch] = []
    have = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        have += b.num_rows
        if have < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = 0
        for k in keys:
            c = t.column(k)
            diff = np.flatnonzero(pa.compute.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False))
            last = max(last, int(diff[-1]) + 1 if len(diff) else 0)
        if last:
            yield t.slice(0, last)
            t = t.slice(last)
        held, have = t.to_batches(), t.num_rows
    if have:
        yield pa.Table.from_batches(held).combine_chunks()


def run_borders(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Start of each run of equal keys in a sorted table, and its end."""
    change = np.zeros(max(t.num_rows - 1, 0), bool)
    for k in keys:
        c = t.column(k)
        change |= pa.compute.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])
