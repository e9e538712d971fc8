"""Suffix-array de-duplication: remove bytes covered by long strings that start twice.

A byte goes if a string of `least` bytes covers it that also starts anywhere else.  Two
starts belong together if their first `least` bytes are equal.  This is anchor hashing,
not prefix doubling: tasks make 64-bit names (rolling hashes) of strings, a pair of names
stands for a longer string, and Spark only brings equal pairs together, in two rounds.  No
ranks are assigned, no offset grows round by round.

Round one does not need every start.  In every window of least/4 starts one *anchor* is
chosen by its content (the least hash, the last of equals), so that equal strings choose
the same one.  All starts of an anchor form its zone.  Anchors are grouped by the pair of
names at 0 and 3/8 of `least`, 3/4 of it together; unique ones drop out with their zones.
If the whole text that a zone's starts cover stands elsewhere too, the zone needs no
further round: all its starts are repeated.  Only in the other zones, at the ends of
repeats, each start goes through the last round by itself, with the pair of names at 0
and least/2.  Of zones with equal text one takes part.

Null and empty texts and those shorter than `least` keep all bytes.  Texts are compared
by content, so repeated rows repeat each other wholly.  Counts of a common passage are
summed before they are shuffled, and no group of equal strings is gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import byte_rows, in_slices, stage, text_key, whole_text

LEAST = 400
GRAM = 16
SLICE = 1 << 20  # bytes of text a task works on at a time; its arrays need some 80 times as many
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


class Names:
    """64-bit names of all strings of a buffer: equal strings have equal names."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power(_INVERSE, len(raw)), dtype=np.uint64)])
        self.power = _power(_BASE, len(raw) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.power[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def paired(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A pair of ranks as one number, which is the rank of the longer string."""
    h = (one ^ (two << np.uint64(23) | two >> np.uint64(41))) * np.uint64(0x9FB21C651E98DF25)
    return (h ^ (h >> np.uint64(35))) + two


def sliding_last_least(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of the least one, the last of equals."""
    n = len(values)
    m = n - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    # place in the low bits, later places smaller, so that a plain minimum finds it
    keyed = (values & ~np.uint64(0xFFFFFFF)) | (np.uint64(0xFFFFFFF) - np.arange(n, dtype=np.uint64))
    pad = -n % w
    k = np.concatenate([keyed, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
    left = np.minimum.accumulate(k, 1).ravel()
    right = np.minimum.accumulate(k[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[:m], left[w - 1: w - 1 + m])
    return (np.uint64(0xFFFFFFF) - (least & np.uint64(0xFFFFFFF))).astype(np.int64)


class Zones:
    """Anchors of texts laid end to end, with the starts that choose each (lo .. hi, both included)."""

    def __init__(self, raw: np.ndarray, borders: np.ndarray, least: int):
        self.raw, self.borders, self.least = raw, borders, least
        self.names = Names(raw)
        window = least // 4
        n = len(raw)
        size = np.diff(borders)
        starts = np.zeros(n + 1, np.int64)  # +1 where a text's starts begin, -1 where they end
        long = size >= least
        np.add.at(starts, borders[:-1][long], 1)
        np.add.at(starts, borders[1:][long] - least + 1, -1)
        p = np.flatnonzero(np.cumsum(starts[:-1]))
        if not len(p):
            self.row = self.anchor = self.lo = self.hi = np.zeros(0, np.int64)
            return
        grams = self.names(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
        chosen = sliding_last_least(grams, window)[p]
        row = np.searchsorted(borders, p, "right") - 1
        # empty texts share a border: the row found is the last one that begins there
        new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(p)]]) - 1
        self.row, self.anchor, self.lo, self.hi = row[first], chosen[first], p[first], p[last]

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Rank pair of each anchor as one name, and the name of all the zone's starts cover."""
        q = 3 * self.least // 8
        one, two = self.names(self.anchor, self.anchor + q), self.names(self.anchor + q, self.anchor + 2 * q)
        cover = self.names(self.lo, self.hi + self.least)
        shape = (self.anchor - self.lo).astype(np.uint64) << np.uint64(32) | (self.hi - self.lo).astype(np.uint64)
        return paired(one, two), cover ^ (shape * np.uint64(_BASE))


def _zones(b: pa.RecordBatch, least: int) -> Zones:
    raw, borders = byte_rows(b.column("_text"))
    return Zones(raw, borders, least)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(whole_text(text).alias("_text")).select(text_key(F.col("_text")).alias("key"), "_text")


def round_one(docs: DataFrame, text: str, least: int) -> DataFrame:
    """who (hash of a text's key), rank, cover, n: how many zones of a text have this anchor rank and covered string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "_text", SLICE):
            z = _zones(b, least)
            if not len(z.row):
                continue
            rank, cover = z.ranks()
            order = np.lexsort((cover, z.row))
            row, rank, cover = z.row[order], rank[order], cover[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (cover[1:] != cover[:-1])]))
            n = np.diff(np.concatenate([first, [len(row)]]))
            yield pa.RecordBatch.from_arrays(
                [b.column("who").take(pa.array(row[first])), pa.array(rank[first].view(np.int64)), pa.array(cover[first].view(np.int64)), pa.array(n, pa.int64())],
                names=["who", "rank", "cover", "n"])

    texts = _texts(docs, text).filter(F.octet_length("_text") >= least).select(F.xxhash64("key").alias("who"), "_text")
    return texts.mapInArrow(run, "who long, rank long, cover long, n long")


def last_round(texts: DataFrame, least: int) -> DataFrame:
    """key, place and rank pair (as one name) of every start in the zones listed in `look` (covered strings)."""
    half = least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "_text", SLICE):
            z = _zones(b, least)
            if not len(z.row):
                continue
            _, cover = z.ranks()
            wanted = listed(b.column("look"), z.row, cover)
            at = np.flatnonzero(wanted)
            n = z.hi[at] - z.lo[at] + 1
            p = np.repeat(z.lo[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            row = np.repeat(z.row[at], n)
            pair = paired(z.names(p, p + half), z.names(p + half, p + least))
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(row)), pa.array((p - z.borders[row]).astype(np.int32)), pa.array(pair.view(np.int64))], names=["key", "place", "pair"])

    return texts.mapInArrow(run, "key binary, place int, pair long")


def listed(lists: pa.Array, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether value i stands in the list of row i."""
    out = np.zeros(len(row), bool)
    cut = np.searchsorted(row, np.arange(len(lists) + 1))
    for i, have in enumerate(lists):
        if have.is_valid and cut[i + 1] > cut[i] and len(have.values):
            out[cut[i]: cut[i + 1]] = np.isin(value[cut[i]: cut[i + 1]].view(np.int64), have.values.to_numpy())
    return out


def found_repeats(docs: DataFrame, text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (key, _text), by key the sure (covered strings of zones wholly repeated), and by key the places (single repeated starts)."""
    # the zones are shuffled once and read twice from there: both readings need all columns and the same filter
    rows = round_one(docs, text, least).filter("rank IS NOT NULL").repartition("rank")
    seen = rows.groupBy("rank").agg(F.sum("n").alias("all"), F.max(F.xxhash64("who", "cover")).alias("last"))
    again = seen.filter("all > 1 AND last IS NOT NULL").select("rank")
    live = stage(rows.join(again, "rank"), "live")
    zones = live.groupBy("cover").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"), F.min("who").alias("who"))  # zones with equal text have one rank
    kinds = zones.groupBy("rank").agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("single"))
    # a zone carries 8 bytes of its text's key.  Texts that share them get both lists, which changes
    # nothing: a list holds covered strings, and each is repeated, or not, wherever it stands
    keys = _texts(docs, text).filter(F.octet_length("_text") >= least).select("key").distinct().select("key", F.xxhash64("key").alias("who"))
    sure = live.join(zones.filter("n > 1").select("cover"), "cover").groupBy("who").agg(F.collect_set("cover").alias("sure"))
    look = zones.join(kinds.filter("kinds > 1 and single > 0").select("rank"), "rank").groupBy("who").agg(F.collect_set("cover").alias("look"))
    sure, look = sure.join(keys, "who").select("key", "sure"), look.join(keys, "who").select("key", "look")
    # one plan from here on: the texts are shuffled once and read twice, the starts as well
    # (said here, the filters that the joins infer are the same on both readings, which then share the shuffles)
    texts = _texts(docs, text).filter("key IS NOT NULL")
    starts = last_round(texts.join(look, "key"), least).filter("key IS NOT NULL AND pair IS NOT NULL").repartition("pair")
    # a copy of a text yields the same (key, place): only different ones count.  A text has
    # each pair for few of its starts, so no pair can hold a large share of all starts
    who = F.xxhash64("key", "place")
    pairs = starts.groupBy("pair").agg(F.min(who).alias("one"), F.max(who).alias("two")).filter("one <> two")
    places = starts.join(pairs.select("pair"), "pair").groupBy("key").agg(F.collect_set("place").alias("places"))
    return texts, sure, places


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (first, end) removed, kept_sha256."""
    texts, sure, places = found_repeats(docs, text, least)
    # all three are dealt by key already, so neither join moves rows again
    source = texts.join(sure, "key", "left").join(places, "key", "left").select("key", "_text", "sure", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "_text", SLICE):
            z = _zones(b, least)
            raw, borders = z.raw, z.borders
            change = np.zeros(len(raw) + 1, np.int64)
            if len(z.row):
                at = np.flatnonzero(listed(b.column("sure"), z.row, z.ranks()[1]))
                np.add.at(change, z.lo[at], 1)
                np.add.at(change, z.hi[at] + least, -1)
                lists = b.column("places")
                flat = lists.flatten().to_numpy().astype(np.int64)
                n = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
                p = flat + np.repeat(borders[:-1], n)
                np.add.at(change, p, 1)
                np.add.at(change, p + least, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept, spans = [], []
            for lo, hi in zip(borders, borders[1:]):
                g = gone[lo:hi]
                kept.append(raw[lo:hi][~g].tobytes())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                spans.append(edge.reshape(-1, 2).tolist())
            n = np.diff(borders)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(n), pa.array([int(x) - len(k) for x, k in zip(n, kept)], pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                 pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept", "spans", "kept_sha256"])

    done = source.mapInArrow(run, "key binary, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>, kept_sha256 string")
    ids = docs.select(text_key(whole_text(text)).alias("key"), F.col(id_col).alias("doc_id"))
    return ids.join(done.dropDuplicates(["key"]), "key").drop("key")
