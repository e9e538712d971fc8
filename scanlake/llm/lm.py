"""Language-model scoring with an n-gram trie of Elias-Fano levels.

Three levels are built from the training texts, each by Spark from counts that tasks have
already summed over their rows:

* words: 64-bit hashes in order as an Elias-Fano sequence (a word's place is its id), and
  their counts as the differences of a second, monotone one;
* pairs and triples: contexts in order as an Elias-Fano sequence (a word's id, or both ids
  of a pair), the ids of the words that follow a context, in order, packed, and an
  Elias-Fano sequence of monotone pointers to where a context's successors begin.  A query
  searches the successor relative to its context.  All pairs and triples are kept, with
  their counts: a byte each, larger ones in a list of their own.

The word level is cut by hash, the others into ranges of (context, word) whose borders come
from a sample, so that a frequent context is spread over several ranges.  The number of
parts follows the input.  Tasks send sorted blocks of summed counts; a part is built from
its blocks one after another, which are summed down whenever FOLD entries are held.  Each
part is a file in the shared folder that scoring tasks map into memory, so that the trie
takes no heap.

Smoothing: p(w | context) = (c + MU * p(w | shorter context)) / (C + MU), with c the count
of the context and word and C the context's: every word but the end token, which is no
context, is followed by one token, so C is the count of the context itself.  A word's own
probability is (c + 1) / (N + V + 1).

Null and empty texts are the end token alone.  Texts are split at ASCII white space;
repeated rows count and score each for itself.  Without training rows all counts are 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import held_out, in_slices, shared_folder, whole_text
from scanlake.llm.compact import EliasFano, elias_fano, map_arrays, pack, search, unpack, write_arrays

MU = 4.0
PART_BYTES = 32 << 20  # of text, for each part of a level
SAMPLE_BYTES, SAMPLE_SHARE, SAMPLE_KEYS = 16 << 20, 0.01, 64  # text at least, share of it, keys a range
FOLD = 4 << 20
END, BEGIN = b" ", b"  "  # no word has white space
BEGIN_ID = 0


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


class Slice:
    """Tokens of some texts: distinct words, each token's place among them, border of each text."""

    def __init__(self, texts: list[str]):
        words: list[bytes] = []
        ends = []
        for t in texts:
            words += tokens(t)
            ends.append(len(words))
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), np.uint64, len(index))
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])


def packed(*arrays: np.ndarray) -> bytes:
    """Sorted arrays as one compressed block: differences of the first, the others as they are."""
    first = np.diff(arrays[0], prepend=np.zeros(1, arrays[0].dtype))
    blocks = [first, *arrays[1:]]
    return len(first).to_bytes(8, "little") + zstandard.compress(b"".join(np.ascontiguousarray(b).tobytes() for b in blocks), 1)


def unpacked(block: bytes, *dtypes: str) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(block[:8], "little"), zstandard.decompress(block[8:]), 0, []
    for t in dtypes:
        a = np.frombuffer(raw, t, n, at)
        at += a.nbytes
        out.append(np.cumsum(a, dtype=a.dtype) if not out else a)
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def shard_of_hash(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def blocks(shard: np.ndarray, shards: int, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Arrays sorted by shard, one block each."""
    cut = np.searchsorted(shard, np.arange(shards + 1))
    return [(s, kind, packed(*[a[lo:hi] for a in arrays])) for s, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo]


_ROW = "shard int, kind int, block binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "kind", "block"])


class Words:
    """The word level: ids from hashes, counts from ids."""

    def __init__(self, folder: str, sizes: list[int]):
        self.shards = len(sizes)
        self.first = np.concatenate([[1], 1 + np.cumsum(sizes)])
        self.parts = []
        for s, n in enumerate(sizes):
            a = map_arrays(folder, f"words-{s}") if n else None
            self.parts.append((EliasFano(a, "h_"), EliasFano(a, "c_")) if n else None)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not there) and counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        cut = np.searchsorted(shard_of_hash(hashes[order], self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            at, p = order[cut[s]: cut[s + 1]], self.parts[s]
            if p is None:
                continue
            i = p[0].successor(hashes[at])
            ok = i < p[0].n
            at, i = at[ok], i[ok]
            same = p[0].get(i) == hashes[at]
            at, i = at[same], i[same]
            ids[at] = self.first[s] + i
            c = p[1]
            counts[at] = (c.get(i) - np.where(i > 0, c.get(np.maximum(i - 1, 0)), 0)).astype(np.int64)
        return ids, counts


class Level:
    """Pairs or triples of one range."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.low, self.bits = (int(x) for x in a["head"])
        self.contexts, self.starts = EliasFano(a, "x_"), EliasFano(a, "p_")
        self.words, self.small, self.at, self.large = a["w"], a["c"], a["at"], a["large"]

    def counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of (context, word), sorted by context: each context is searched once."""
        out = np.zeros(len(context), np.int64)
        new = np.concatenate([[True], context[1:] != context[:-1]])
        x = context[new] - self.low
        there = np.flatnonzero(x >= 0)
        x = x[there].astype(np.uint64)
        i = self.contexts.successor(x)
        ok = np.flatnonzero(i < self.contexts.n)
        ok = ok[self.contexts.get(i[ok]) == x[ok]]
        there, i = there[ok], i[ok]
        lo, hi = np.zeros(new.sum(), np.int64), np.zeros(new.sum(), np.int64)
        lo[there], hi[there] = self.starts.get(i), self.starts.get(i + 1)
        own = np.cumsum(new) - 1
        q = np.flatnonzero((hi > lo)[own])
        lo, hi, key = lo[own[q]], hi[own[q]], word[q].astype(np.uint64)
        at = search(lambda k: unpack(self.words, self.bits, k), lo, hi, key)
        ok = at < hi
        ok[ok] = unpack(self.words, self.bits, at[ok]) == key[ok]
        at, q = at[ok], q[ok]
        c = self.small[at].astype(np.int64)
        many = np.flatnonzero(c == 255)
        c[many] = self.large[np.searchsorted(self.at, at[many])]
        out[q] = c
        return out


def write_level(folder: str, name: str, bits: int, context: np.ndarray, word: np.ndarray, c: np.ndarray) -> None:
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    x = context[first] - context[0]
    many = np.flatnonzero(c >= 255)
    a = {"head": np.array([context[0], bits], np.int64), "w": pack(word, bits), "c": np.minimum(c, 255).astype(np.uint8), "at": many, "large": c[many]}
    a |= {f"x_{k}": v for k, v in elias_fano(x, int(x[-1]) + 1).items()}
    a |= {f"p_{k}": v for k, v in elias_fano(np.concatenate([first, [len(word)]]), len(word) + 1).items()}
    write_arrays(folder, name, a)


def cuts(context: np.ndarray, word: np.ndarray, borders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where the ranges begin in sorted (context, word), and the end."""
    lo, hi = (np.searchsorted(context, borders[0], side) for side in ("left", "right"))
    return np.concatenate([[0], search(lambda i: word[i], lo, hi, borders[1]), [len(context)]])


def in_parts(blocks: DataFrame, parts: int, add, build, result: str) -> DataFrame:
    """Rows of `build` for each (kind, shard): it gets what `add` made of the blocks, one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            for kind, shard, block in zip(b.column("kind").to_pylist(), b.column("shard").to_pylist(), b.column("block")):
                if (kind, shard) != now:
                    if now:
                        yield build(*now, held)
                    now, held = (kind, shard), []
                add(kind, held, block.as_py())
        if now:
            yield build(*now, held)

    return blocks.repartition(parts, "kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(run, result)


def folded(held: list[tuple[np.ndarray, ...]], most: int = 0) -> None:
    """Sum blocks of (context, word, count), or (key, count), down to one once they hold over `most` entries.

    What is summed already counts as little until as much has come again.
    """
    if len(held) < 2 or sum(len(h[0]) for h in held[1:]) <= max(most, len(held[0][0]) if most else 0):
        return
    columns = [np.concatenate(x) for x in zip(*held)]
    held.clear()
    if len(columns) == 2:
        held.append(summed(*columns))
        return
    kinds, at = np.unique(columns[0], return_inverse=True)
    key, c = summed(at.astype(np.uint64) << np.uint64(32) | columns[1].astype(np.uint64), columns[2])
    held.append((kinds[(key >> np.uint64(32)).astype(np.int64)], (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), c))


def count_words(docs: DataFrame, folder: str, shards: int) -> tuple[list[int], int]:
    """Write the word level; sizes of its shards and the number of tokens."""
    source = docs.select(whole_text("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "_text", 16 << 20):
            s = Slice(b.column("_text").to_pylist())
            c = np.bincount(s.at, minlength=len(s.hashes))
            order = np.argsort(s.hashes)
            h = s.hashes[order]
            yield _batch(blocks(shard_of_hash(h, shards), shards, 1, h, c[order].astype("<u4")))

    def add(kind: int, held: list, block: bytes) -> None:
        h, c = unpacked(block, "<u8", "<u4")
        held.append((h, c.astype(np.uint64)))
        folded(held, FOLD)

    def build(kind: int, s: int, held: list) -> pa.RecordBatch:
        folded(held)
        h, c = held[0]
        total = np.cumsum(c)
        arrays = {f"h_{k}": v for k, v in elias_fano(h, 1 << 64).items()}
        arrays |= {f"c_{k}": v for k, v in elias_fano(total, int(total[-1]) + 1).items()}
        write_arrays(folder, f"words-{s}", arrays)
        return pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "n": [len(h)], "total": [int(total[-1])]})

    made = in_parts(source.mapInArrow(run, _ROW), shards, add, build, "shard int, n long, total long").collect()
    sizes = [0] * shards
    for r in made:
        sizes[r["shard"]] = r["n"]
    return sizes, sum(r["total"] for r in made)


@lru_cache(maxsize=1)
def _words(folder: str, sizes: tuple[int, ...]) -> Words:
    return Words(folder, list(sizes))


@lru_cache(maxsize=4096)
def _level(folder: str, name: str) -> Level:
    return Level(map_arrays(folder, name))


def chains(s: Slice, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: its id, the id before it, and the one before that (-2: none)."""
    w = ids[s.at]
    one = np.concatenate([[BEGIN_ID], w[:-1]])
    one[s.starts] = BEGIN_ID
    two = np.concatenate([[-2], one[:-1]])
    two[s.starts] = -2
    return w, one, two


def followers(s: Slice, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(2 or 3, context, word, count) of a slice without unknown words, sorted."""
    w, one, two = chains(s, ids)
    pair, back, c = np.unique(one << 32 | w, return_inverse=True, return_counts=True)
    yield 2, pair >> 32, pair & 0xFFFFFFFF, c
    # the triple (two, one, w) as the pair (two, one) of the token before, and w
    i = np.flatnonzero(two >= 0)
    key, c = np.unique(back[i - 1] << 32 | w[i], return_counts=True)
    yield 3, pair[key >> 32], key & 0xFFFFFFFF, c


def sampled_borders(source: DataFrame, size: int, ranges: int, folder: str, sizes: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By level: the (context, word) at which ranges begin, all but the first, from a sample of the texts."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(1, size)))
    rate = min(1.0, SAMPLE_KEYS * ranges / max(1.0, share * size / 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(folder, sizes)
        for b in in_slices(batches, "_text", 16 << 20):
            s = Slice(b.column("_text").to_pylist())
            g = np.random.default_rng([len(s.at), int(s.hashes[0])])
            for kind, context, word, c in followers(s, words.look_up(s.hashes)[0]):
                at = np.flatnonzero(g.random(len(c)) < rate)  # an entry of a block is one, whatever its count
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(context[at], pa.int64()), pa.array(word[at], pa.int64())], names=["kind", "context", "word"])

    some = source if share == 1.0 else source.sample(share, 11)
    # a fixed number of keys a range
    got = some.mapInArrow(run, "kind int, context long, word long").collect()
    out = {}
    for kind in (2, 3):
        keys = sorted((r["context"], r["word"]) for r in got if r["kind"] == kind)
        chosen = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
        out[kind] = tuple(np.array([x[j] for x in chosen], np.int64) for j in (0, 1))
    return out


def count_follow(docs: DataFrame, folder: str, sizes: list[int], size: int, ranges: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], frozenset[tuple[int, int]]]:
    """Write the ranges of pairs and triples; their borders, and the (level, range) there are."""
    source = docs.select(whole_text("text").alias("_text"))
    fixed = tuple(sizes)
    bits = (sum(sizes) + 1).bit_length()
    borders = sampled_borders(source, size, ranges, folder, fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(folder, fixed)
        for b in in_slices(batches, "_text", 16 << 20):
            s = Slice(b.column("_text").to_pylist())
            for kind, context, word, c in followers(s, words.look_up(s.hashes)[0]):
                cut = cuts(context, word, borders[kind])
                arrays = context.astype("<u8"), word.astype("<u4"), c.astype("<u4")
                yield _batch([(k, kind, packed(*[a[lo:hi] for a in arrays])) for k, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo])

    def add(kind: int, held: list, block: bytes) -> None:
        context, word, c = unpacked(block, "<u8", "<u4", "<u4")
        held.append((context, word, c.astype(np.int64)))
        folded(held, FOLD)

    def build(kind: int, k: int, held: list) -> pa.RecordBatch:
        folded(held)
        write_level(folder, f"follow{kind}-{k}", bits, *held[0])
        return pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "shard": pa.array([k], pa.int32())})

    made = in_parts(source.mapInArrow(run, _ROW), 2 * ranges, add, build, "kind int, shard int").collect()
    return borders, frozenset((r["kind"], r["shard"]) for r in made)


class Model:
    """Where the levels are, and the totals."""

    def __init__(self, folder: str, sizes: list[int], total: int, texts: int, borders: dict[int, tuple[np.ndarray, np.ndarray]], there: frozenset[tuple[int, int]]):
        self.folder, self.sizes, self.total, self.texts = folder, tuple(sizes), total, texts
        self.borders, self.there = borders, there
        self.kinds = sum(sizes)

    def counts(self, kind: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of sorted (context, word)."""
        out = np.zeros(len(context), np.int64)
        if self.there:
            cut = cuts(context, word, self.borders[kind])
            for k in np.flatnonzero(np.diff(cut)).tolist():
                if (kind, k) in self.there:
                    part = slice(cut[k], cut[k + 1])
                    out[part] = _level(self.folder, f"follow{kind}-{k}").counts(context[part], word[part])
        return out


def train(docs: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """Build the trie in the shared folder; its number of parts follows the size of the texts."""
    spark = docs.sparkSession
    d = docs.select(F.col(text).alias("text"))
    size, texts = d.agg(F.coalesce(F.sum(F.octet_length(whole_text("text"))), F.lit(0)), F.count("*")).first()
    shards = shards or max(8, ceil(size / PART_BYTES))
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    sizes, total = count_words(d, folder, shards)
    if sum(sizes) >= 2**31 - 1:
        raise ValueError("more distinct words than 31-bit ids")
    return Model(folder, sizes, total, texts, *(count_follow(d, folder, sizes, size, shards) if total else ({}, frozenset())))


def score_slice(m: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base score, score."""
    s = Slice(texts)
    ids, counts = _words(m.folder, m.sizes).look_up(s.hashes)
    share = (counts + 1) / (m.total + m.kinds + 1)
    base = np.log10(share)
    w, one, two = chains(s, ids)
    before = np.concatenate([[m.texts], counts[s.at][:-1]])
    before[s.starts] = m.texts
    pair, back = np.unique((one + 1) << 32 | (w + 1), return_inverse=True)
    prev, cur = (pair >> 32) - 1, (pair & 0xFFFFFFFF) - 1
    known = np.flatnonzero((prev >= 0) & (cur >= 0))
    c2 = np.zeros(len(pair), np.int64)
    c2[known] = m.counts(2, prev[known], cur[known])
    p = (c2[back] + MU * share[s.at]) / (before + MU)
    i = np.flatnonzero(two >= 0)
    i = i[c2[back[i - 1]] > 0]
    key, back3 = np.unique(back[i - 1] << 32 | (w[i] + 1), return_inverse=True)
    context, cur3 = key >> 32, (key & 0xFFFFFFFF) - 1
    known = np.flatnonzero(cur3 >= 0)
    c3 = np.zeros(len(key), np.int64)
    c3[known] = m.counts(3, prev[context[known]] << 32 | cur[context[known]], cur3[known])
    p[i] = (c3[back3] + MU * p[i]) / (c2[back[i - 1]] + MU)
    total = lambda x: np.add.reduceat(x, s.starts)  # noqa: E731  every text has a token
    return s.ends - s.starts, total((counts > 0)[s.at].astype(np.int64)), total(base[s.at]), total(np.log10(p))


def score(docs: DataFrame, m: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every document."""
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "_text", 12 << 20):
            n, known, base, full = score_slice(m, b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), m.total), pa.int64()), pa.array(base), pa.array(full)],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """Scores of every document, with the model of those not held out."""
    m = train(docs.filter(~held_out("doc_id", mod, rest)))
    return score(docs, m).select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
