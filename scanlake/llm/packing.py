"""Packing: harmonic packing of token sequences into bins of a fixed capacity.

A document's tokens are cut into pieces: whole bins first, then the largest share
capacity/k that fits, again and again, until less than capacity/8 is left, which is the
last piece.  A piece of class k is longer than capacity/(k+1) and not longer than
capacity/k, and a bin of class k takes exactly k pieces of that class, so that bins are
filled by counting alone: each worker numbers its pieces of a class, a table of counts a
worker and class gives where its numbers start, and number // k is the bin.

The last bin of a class may lack pieces.  Those pieces (fewer than k a class, so a number
bounded by the capacity alone) are packed together, longest first.

Null and empty texts are one document of the end token alone.  Repeated rows are packed
each for itself.  A text that spells a special token is encoded as the tokenizer does.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import hold, in_slices, stage, whole_text

CAPACITY = 2048
END = 1
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The tokenizer's own cut into pieces, for texts of the characters below.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
#: Other characters: such texts, and those that spell a special token, go to the tokenizer whole.
_OTHER = re.compile(rf"[^\n -~{_LETTER}]")
_SPECIAL = "<|endoftext|>"
#: Pieces already encoded: those met lately, and those before them.
_KNOWN: list[dict[str, bytes]] = [{}, {}]
_KNOWN_MOST = 500_000
_TOKENIZER: dict[str, object] = {}


def _drop() -> None:
    _TOKENIZER.clear()
    _KNOWN[:] = [{}, {}]


def encoder(path: str):
    """texts -> token ids of each as little-endian unsigned 32-bit integers.

    Pieces that repeat are looked up; the new ones of all texts are encoded in one call.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
    from tokenizers import Tokenizer

    hold("packing", _drop)
    if path not in _TOKENIZER:
        _drop()
        _TOKENIZER[path] = Tokenizer.from_file(path)
    tok = _TOKENIZER[path]

    def ids_of(strings: list[str]) -> Iterator[bytes]:
        for e in tok.encode_batch_fast(strings, add_special_tokens=False) if strings else ():
            yield struct.pack(f"<{len(e)}I", *e.ids)

    def encode(texts: list[str]) -> Iterator[bytes]:
        found = [None if _OTHER.search(t) or _SPECIAL in t else _PIECES.findall(t) for t in texts]
        used = set().union(*filter(None, found))
        if len(_KNOWN[0]) > _KNOWN_MOST:
            _KNOWN[:] = [{}, _KNOWN[0]]
        late, early = _KNOWN
        new = []
        for u in used.difference(late):
            if (known := early.get(u)) is None:
                new.append(u)
            else:
                late[u] = known
        late.update(zip(new, ids_of(new), strict=True))
        for t, f in zip(texts, found):
            yield next(ids_of([t])) if f is None else b"".join(map(late.__getitem__, f))

    return encode


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest >= max(1, capacity // 8):
        k = -(-capacity // rest)
        out.append((capacity // k, k))
        rest -= capacity // k
    if rest:
        out.append((rest, capacity // rest))
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, kind (its class)."""
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), END.to_bytes(4, "little")
        for b in in_slices(batches, "_text", 1 << 20):
            row, start, length, crc, total, cls = [], [], [], [], [], []
            for i, ids in enumerate(encode(b.column("_text").to_pylist())):
                ids += end
                n, at = len(ids) // 4, 0
                for size, k in cuts(n, capacity):
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at: 4 * (at + size)]))
                    total.append(n)
                    cls.append(k)
                    at += size
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, long)), *[pa.array(x, long) for x in (start, length, crc, total, cls)]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind"])

    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, kind long")


def first_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack the pieces of unfilled bins, longest first, each into the first bin with room."""
    rows = rows.sort_values(["length", "w", "n"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    free: list[int] = []
    bins, offsets = [], []
    for size in rows["length"]:
        at = next((i for i, f in enumerate(free) if f >= size), len(free))
        if at == len(free):
            free.append(capacity)
        bins.append(at)
        offsets.append(capacity - free[at])
        free[at] -= int(size)
    rows["slot"], rows["offset"] = bins, offsets
    return rows


def harmonic_pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (columns length and kind among others)."""
    numbered = made.withColumn("w", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id())
    p = stage(numbered, "pieces")
    cols = [c for c in made.columns if c != "kind"]
    # bins of a class are filled in the order (worker, number); workers' counts are a small table
    counts = p.groupBy("kind", "w").agg(F.count("*").alias("c"))
    by_kind = Window.partitionBy("kind").orderBy("w")
    starts = counts.select(
        "kind", "w", (F.sum("c").over(by_kind) - F.col("c")).alias("before"),
        F.sum("c").over(Window.partitionBy("kind")).alias("all"))
    within = Window.partitionBy("kind", "w").orderBy("n")
    r = p.withColumn("i", F.row_number().over(within) - 1).join(starts, ["kind", "w"])
    r = r.withColumn("i", F.col("i") + F.col("before")).withColumn("slot", F.floor(F.col("i") / F.col("kind")))
    r = stage(r.withColumn("whole", (F.col("slot") + 1) * F.col("kind") <= F.col("all")), "numbered")
    full = r.filter("whole")
    in_bin = Window.partitionBy("kind", "slot").orderBy("i")
    full = full.withColumn("offset", F.sum("length").over(in_bin) - F.col("length"))
    # ids: classes are numbered 1 .. capacity, so (slot, kind) needs no further pass
    full = full.select(*cols, (F.col("slot") * (capacity + 1) + F.col("kind")).alias("sequence_id"), "offset")
    left = r.filter("not whole").select(*cols, "w", "n")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
    rest = left.groupBy().applyInPandas(lambda x: first_fit(x, capacity), fields + ", slot long, offset long")
    rest = rest.select(*cols, (F.col("slot") * (capacity + 1)).alias("sequence_id"), "offset")
    return full.unionByName(rest)
