"""Benchmark decontamination: CGK random walks, bit-sampling LSH, exact edit distance.

A text is read as bytes with A-Z made lower-case and white space made blank.  A document leaks an item
if some part of it is within EDITS * length edits of the whole item.

1. Windows.  A window starts at a word or where a run of grams (GRAM bytes) shared with the
   benchmark begins, and is as long as the longest item of its size class (classes double).
   By the q-gram lemma a window that holds an item within the allowed edits shares at least
   `need` grams with it; windows with fewer shared grams are passed over.  The set of the
   benchmark's grams is a bit map of fixed size: a larger benchmark only fills it further.
   A class whose items are too short for the lemma looks at every start.
2. Embedding.  A random walk reads a window: step j puts out the byte under the pointer,
   and a random bit of (j, byte) says whether the pointer moves on.  Windows a few edits
   apart meet again after an edit and agree in most places, so edit distance becomes
   Hamming distance.
3. LSH.  Each of WALKS walks is sampled SAMPLES times at BITS places within the class's
   length; equal samples make candidates.  With a share d of unequal places a pair is found
   with probability 1 - (1 - (1 - d)^BITS)^(WALKS * SAMPLES): 0.99 at d = 0.3, 1 for exact
   copies.  A second bit map of fixed size, of the items' samples, lets windows without any
   equal sample drop out before they are shuffled.
4. Candidates are verified by bit-parallel edit distance with a free end.

Null and empty texts and items match nothing.  Items with equal text each get their rows;
repeated documents too.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from scanlake.llm.common import byte_rows, hold, in_slices, stage, text_key, whole_text
from scanlake.llm.suffixes import Names

EDITS = 0.05
GRAM = 12
MAP_BITS = 24
PART = 1 << 15  # bits that bitmap_construct_agg holds
WALKS, SAMPLES, BITS = 8, 5, 6
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32


def plain(raw: np.ndarray) -> np.ndarray:
    """Lower-case bytes, white space blank; the length stays."""
    return _PLAIN[raw]


def allowed(n: int) -> int:
    return int(EDITS * n)


def size_class(n: int) -> int:
    return max(1, n).bit_length()


def gram_slots(raw: np.ndarray) -> np.ndarray:
    """Slot in the bit map of the gram at every place (the last GRAM - 1 places have none)."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    return (Names(raw)(at, at + GRAM) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def walk(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, wanted: np.ndarray) -> np.ndarray:
    """Bytes put out at the steps `wanted` (ascending) of the walk from each start; 0 past the end."""
    moves = np.random.default_rng((977, seed)).integers(0, 2, (int(wanted[-1]) + 1, 256), dtype=np.uint8)
    pos = starts.copy()
    out = np.zeros((len(wanted), len(starts)), np.uint8)
    k = 0
    last = len(raw) - 1
    for j in range(int(wanted[-1]) + 1):
        byte = np.where(pos < ends, raw[np.minimum(pos, last)], np.uint8(0))
        if j == wanted[k]:
            out[k] = byte
            k += 1
        pos += moves[j, byte]
    return out


def sampled_places(cls: int, w: int) -> list[np.ndarray]:
    """Places of a walk that each sample of a class reads: within the steps that pass its least length."""
    g = np.random.default_rng((cls, w, 31))
    return [np.sort(g.choice(2 << (cls - 1), BITS, replace=False)) if 2 << (cls - 1) > BITS else np.arange(2 << (cls - 1)) for _ in range(SAMPLES)]


def lsh_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, cls: int) -> np.ndarray:
    """(samples, windows) 64-bit keys; the class and the sample are part of a key."""
    keys = []
    for w in range(WALKS):
        places = sampled_places(cls, w)
        wanted = np.unique(np.concatenate(places))
        out = walk(raw, starts, ends, w, wanted)
        for s, p in enumerate(places):
            h = np.full(len(starts), (cls * WALKS + w) * SAMPLES + s + 1, np.uint64)
            for row in np.searchsorted(wanted, p):
                h = (h ^ out[row].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            keys.append(h)
    return np.array(keys).view(np.int64)


def edits_at_start(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edit distance of the item to a beginning of the text, and that beginning's length.

    Bit-parallel: one machine-word operation of n bits a byte of the text.
    """
    n = len(item)
    if text.startswith(item):
        return 0, n
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, length = full, 0, n, n, 0
    for j, c in enumerate(text[: n + most]):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, length = score, j + 1
    return best, length


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).alias("item_id"), whole_text(text).alias("_text")).filter("_text <> ''")


def gram_map(items: DataFrame) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Bit map of the items' grams, and the items' lengths by class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "_text"):
            for t in b.column("_text").to_pylist():
                raw = plain(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
                slots = np.unique(gram_slots(raw))
                yield pa.RecordBatch.from_arrays([pa.array([*slots.tolist(), -len(raw)], pa.int64())], names=["v"])

    # lengths are negative: a row of the distinct ones, which are few
    found = items.select("_text").mapInArrow(run, "v long").withColumn("n", F.when(F.col("v") < 0, -F.col("v")))
    got = bit_rows(found, F.collect_set("n").alias("n"))
    classes: dict[int, list[int]] = {}
    for n in sorted(n for r in got if r["part"] < 0 for n in r["n"]):
        classes.setdefault(size_class(n), []).append(n)
    return bit_map(got), classes


def bit_rows(slots: DataFrame, *more: Column) -> list[Row]:
    """(part, bits) of column v, made in Spark: at most 2^MAP_BITS / PART rows, and part -1 of negative ones."""
    part = F.when(F.col("v") < 0, F.lit(-1)).otherwise(F.shiftright("v", PART.bit_length() - 1))
    place = F.when(F.col("v") >= 0, F.col("v").bitwiseAND(F.lit(PART - 1)))
    return slots.withColumn("part", part.cast("int")).withColumn("place", place).groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits"), *more).collect()


def bit_map(rows: list[Row]) -> np.ndarray:
    bits = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in rows:
        if r["part"] >= 0:
            at = r["part"] * PART // 8
            bits[at: at + PART // 8] = np.packbits(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))
    return bits


def key_map(known: DataFrame) -> np.ndarray:
    """Bit map of the items' LSH keys."""
    slots = known.select(F.explode("keys").alias("k")).select(F.shiftrightunsigned("k", 64 - MAP_BITS).alias("v"))
    return bit_map(bit_rows(slots))


def in_map(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


def need(n: int) -> int:
    """Grams that a window with an item of n bytes shares with it at least."""
    return n - GRAM + 1 - allowed(n) * GRAM


def find_windows(raw: np.ndarray, borders: np.ndarray, bits: np.ndarray, classes: dict[int, list[int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, rows, starts) of the windows with enough shared grams; raw is plain."""
    n = len(raw)
    slots = gram_slots(raw)
    hit = np.zeros(n + 1, bool)
    hit[: len(slots)] = in_map(bits, slots)
    blank = np.concatenate([[True], raw == 32])
    begins = blank[:-1] & ~blank[1:]
    size = np.diff(borders)
    begins[borders[:-1][size > 0]] = True
    begins[1:] |= hit[1:n] & ~hit[: n - 1]
    starts = np.flatnonzero(begins)
    row = np.searchsorted(borders, starts, "right") - 1
    count = np.concatenate([[0], np.cumsum(hit[:n])])
    for cls, lengths in classes.items():
        longest = lengths[-1]
        end = np.minimum(starts + longest + allowed(longest), borders[row + 1])
        at = np.flatnonzero(count[end] - count[starts] >= min(map(need, lengths)))
        ok = np.zeros(len(at), bool)
        for size in lengths:
            end = np.minimum(starts[at] + size + allowed(size), borders[row[at] + 1])
            ok |= count[end] - count[starts[at]] >= need(size)
        yield cls, row[at[ok]], starts[at[ok]]


_FOUND = "key binary, doc_id {kind}, start long, cls int, text binary, keys array<long>"


def windows(docs: DataFrame, bits: np.ndarray, classes: dict[int, list[int]], samples: np.ndarray, id_col: str, text: str) -> DataFrame:
    """Windows that may hold an item, their bytes and those LSH keys that an item may have."""
    t = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("_text")).filter("_text <> ''")
    t = t.select(text_key(F.col("_text")).alias("key"), "doc_id", "_text")
    kind = t.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((bits, samples))  # bounded: 2^MAP_BITS bits each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("decontaminate", lambda: None)
        table, of_items = sent.value
        for b in in_slices(batches, "_text", 1 << 20):
            raw, borders = byte_rows(b.column("_text"))
            raw = plain(raw)
            for cls, row, starts in find_windows(raw, borders, table, classes):
                longest = classes[cls][-1] + allowed(classes[cls][-1])
                for lo in range(0, len(starts), 20_000):
                    r, s = row[lo: lo + 20_000], starts[lo: lo + 20_000]
                    ends = np.minimum(s + longest, borders[r + 1])
                    keys = lsh_keys(raw, s, ends, cls)
                    maybe = in_map(of_items, (keys.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64))
                    at = np.flatnonzero(maybe.any(0))
                    if not len(at):
                        continue
                    r, s, ends = r[at], s[at], ends[at]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("key").take(pa.array(r)), b.column("doc_id").take(pa.array(r)), pa.array(s - borders[r], pa.int64()), pa.array(np.full(len(s), cls), pa.int32()),
                         pa.array([raw[i:j].tobytes() for i, j in zip(s, ends)], pa.binary()),
                         pa.array([keys[maybe[:, i], i].tolist() for i in at], pa.list_(pa.int64()))],
                        names=["key", "doc_id", "start", "cls", "text", "keys"])

    return t.mapInArrow(run, _FOUND.format(kind=kind))


def item_keys(items: DataFrame) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "_text"):
            raw, borders = byte_rows(b.column("_text"))
            raw = plain(raw)
            keys = []
            for lo, hi in zip(borders, borders[1:]):
                keys.append(lsh_keys(raw, np.array([lo]), np.array([hi]), size_class(int(hi - lo)))[:, 0].tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), pa.array([raw[lo:hi].tobytes() for lo, hi in zip(borders, borders[1:])], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["item_id", "item", "keys"])

    return items.mapInArrow(run, f"item_id {kind}, item binary, keys array<long>")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """key (of the text), doc_id, item_id, edits, start, length: the best place of each item in each document."""
    items = _items(benchmark, item_id, item_text)
    bits, classes = gram_map(items)
    known = stage(item_keys(items), "items")
    found = stage(windows(docs, bits, classes, key_map(known), id_col, text), "windows")
    w = found.select(F.xxhash64("key", "start", "cls").alias("w"), F.explode(F.array_distinct("keys")).alias("k")).distinct()
    i = known.select("item_id", F.explode(F.array_distinct("keys")).alias("k"))
    pairs = w.join(i, "k").select("w", "item_id").distinct()
    full = found.select("key", "doc_id", "start", "text", F.xxhash64("key", "start", "cls").alias("w")).join(pairs, "w").join(known.select("item_id", "item"), "item_id")
    kinds = {f.name: f.dataType.simpleString() for f in full.schema.fields}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, n, keep = [], [], []
            for k, (item, t) in enumerate(zip(b.column("item").to_pylist(), b.column("text").to_pylist())):
                d, size = edits_at_start(item, t, allowed(len(item)))
                if d <= allowed(len(item)):
                    keep.append(k)
                    e.append(d)
                    n.append(size)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(at) for c in ("key", "doc_id", "item_id", "start")], pa.array(e, pa.int64()), pa.array(n, pa.int64())],
                names=["key", "doc_id", "item_id", "start", "edits", "length"])

    ok = full.select("key", "doc_id", "item_id", "start", "item", "text").mapInArrow(
        verify, f"key binary, doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, start long, edits long, length long")
    best = ok.groupBy("key", "doc_id", "item_id").agg(F.min(F.struct("edits", "start", "length")).alias("b"))
    return best.select("key", "doc_id", "item_id", "b.edits", "b.start", "b.length")


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark item, with their columns."""
    bad = leaks(docs, benchmark).select("key").distinct()
    return docs.withColumn("_key", text_key(whole_text("text"))).join(bad.withColumnRenamed("key", "_key"), "_key", "left_anti").drop("_key").select(*docs.columns)
