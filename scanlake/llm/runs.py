"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q (words q apart are identical), at least
max(LEAST, TIMES * q) words long, that no neighbouring word extends keeping period q.

Words become integers; the documents of a slice stand end to end with a separator of its own
between each two.  At scale B = 1, 2, 4, ... the sequence is cut into blocks of B words.  A
run of period B <= q < 2B is so long that it contains a whole block and the block's copy q
words later; so at each scale every block is compared with the window of the B .. 2B-1 next
distances.  The sum of squared differences

    sum x^2 + sum y^2 - 2 sum x y

of all distances comes from prefix sums and one correlation, a number-theoretic transform
modulo enough primes that a sum is zero exactly where it is zero modulo all of them.
A zero is an occurrence without mismatch; its distance seeds an extension to both sides,
and what is long enough is a run.  An interval found with several distances keeps the least,
which divides the others.

Left out before the transform, without loss: blocks with a word whose next occurrence lies
2B or further on, and blocks whose whole window lies inside a run of a smaller period (all
their distances are multiples of it).

Null and empty texts have no words and no runs.  A document is handled in the task that
reads it, so a very long one needs memory in proportion to its length; nothing else does.
Rows are independent of each other: repeated rows get equal results, and an empty table
gives an empty result.  Columns of `docs` other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import in_slices, whole_text

LEAST, TIMES = 6, 4
#: Primes k * 2^m + 1 below 2^31 with m >= 25, and a generator of each.
PRIMES = ((2013265921, 31), (2113929217, 5), (1811939329, 13))
BATCH = 1 << 18


@lru_cache(maxsize=64)
def twiddles(size: int, prime: int, generator: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity of each level, the widest level first."""
    root = pow(generator, (prime - 1) // size, prime)
    if inverse:
        root = pow(root, prime - 2, prime)
    out = []
    while size > 1:
        w = np.ones(size // 2, np.uint64)
        step, have = root, 1
        while have < size // 2:  # double the known powers
            w[have: 2 * have] = w[:have] * np.uint64(pow(step, have, prime)) % np.uint64(prime)
            have *= 2
        out.append(w)
        root = root * root % prime
        size //= 2
    return out


def transform(x: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Number-theoretic transform of each row; the result is in bit-reversed order."""
    p, rows = np.uint64(prime), len(x)
    x = x.copy()
    for w in twiddles(x.shape[1], prime, generator, False):
        h = len(w)
        v = x.reshape(rows, -1, 2, h)
        a, b = v[:, :, 0].copy(), v[:, :, 1]
        v[:, :, 0], v[:, :, 1] = (a + b) % p, (a + p - b) % p * w % p
    return x


def inverse_transform(x: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Undo `transform`: takes bit-reversed order, gives natural order."""
    p, rows, size = np.uint64(prime), len(x), x.shape[1]
    x = x.copy()
    for w in reversed(twiddles(size, prime, generator, True)):
        h = len(w)
        v = x.reshape(rows, -1, 2, h)
        a, b = v[:, :, 0].copy(), v[:, :, 1] * w % p
        v[:, :, 0], v[:, :, 1] = (a + b) % p, (a + p - b) % p
    return x * np.uint64(pow(size, prime - 2, prime)) % p


def occurrences(blocks: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """Where row i of `blocks` (B wide) stands in row i of `windows` (2B wide): booleans for offsets 0 .. B-1.

    Numbers are below `most`; the primes' product exceeds the largest sum of squared differences.
    """
    rows, size = blocks.shape
    zero = np.ones((rows, size), bool)
    product, bound = 1, size * most * most
    for prime, generator in PRIMES:
        p = np.uint64(prime)
        x, y = blocks % p, windows % p
        turned = np.zeros_like(y)  # the block backwards, from place 0 down
        turned[:, 0] = x[:, 0]
        turned[:, 2 * size - np.arange(1, size)] = x[:, 1:]
        cross = inverse_transform(transform(turned, prime, generator) * transform(y, prime, generator) % p, prime, generator)[:, :size]
        squares = np.concatenate([np.zeros((rows, 1), np.uint64), np.cumsum(y * y % p, axis=1)], axis=1)
        total = (x * x % p).sum(axis=1, dtype=np.uint64)[:, None] + squares[:, size: 2 * size] - squares[:, :size]
        zero &= total % p == 2 * cross % p
        product *= prime
        if product > bound:
            return zero
    raise ValueError(f"{most} different words are too many for blocks of {size}")


def extend(x: np.ndarray, at: int, d: int, size: int) -> tuple[int, int]:
    """The largest interval around [at, at + size + d) whose numbers d apart are equal."""
    n = len(x) - d
    right, step = at + size, 64
    while right < n:
        same = x[right: min(right + step, n)] == x[right + d: min(right + step, n) + d]
        if not same.all():
            right += int(np.argmin(same))
            break
        right, step = right + len(same), step * 2
    left, step = at, 64
    while left:
        lo = max(0, left - step)
        same = (x[lo:left] == x[lo + d: left + d])[::-1]
        if not same.all():
            left -= int(np.argmin(same))
            break
        left, step = lo, step * 2
    return left, right + d


def find_runs(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in x, by start and period; no run is longer than `longest`."""
    n = len(x)
    if not n:
        return []
    order = np.argsort(x, kind="stable")
    gap = np.full(n, n, np.int64)  # to the next occurrence of the same number
    again = x[order[1:]] == x[order[:-1]]
    gap[order[:-1][again]] = order[1:][again] - order[:-1][again]
    most = int(x.max()) + 1
    padded = x.astype(np.uint64)
    reach = np.zeros(n, np.int64)  # the end of the longest run found so far over a place
    found: dict[tuple[int, int], int] = {}
    size, widest = 1, gap
    while size <= longest // TIMES:
        at = np.flatnonzero(widest < 2 * size) * size
        at = at[at + 2 * size <= n]
        at = at[reach[at] < at + 3 * size]
        seeds = []
        many = max(1, BATCH // (2 * size))
        for lo in range(0, len(at), many):
            some = at[lo: lo + many]
            places = some[:, None] + size + np.arange(2 * size)
            windows = np.where(places < n, padded[np.minimum(places, n - 1)], np.uint64(most))
            hit, shift = np.nonzero(occurrences(padded[some[:, None] + np.arange(size)], windows, most + 1))
            seeds.append(np.stack([shift + size, some[hit]]))
        if seeds:
            d, i = np.concatenate(seeds, axis=1)
            new = reach[i] < i + size + d
            d, i = d[new], i[new]
            last = (0, 0, 0)
            for k in np.lexsort((i, d)).tolist():
                period, place = int(d[k]), int(i[k])
                if last[0] == period and last[1] <= place and place + size + period <= last[2]:
                    continue
                last = (period, *extend(x, place, period, size))
                if last[2] - last[1] >= max(LEAST, TIMES * period):
                    found[last[1:]] = min(found.get(last[1:], period), period)
            for s, e in found:
                if size <= found[s, e] < 2 * size:
                    reach[s:e] = np.maximum(reach[s:e], e)
        size *= 2
        full = len(widest) // 2 * 2
        widest = np.append(np.maximum(widest[0:full:2], widest[1:full:2]), np.full(len(widest) - full, n, np.int64))
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


Edit = Callable[[object, list[bytes]], list[bytes]]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", edit: Edit | None = None) -> DataFrame:
    """One row a document: doc_id, runs (array of start, length, period by start and period), text.

    Places count words from 0.  The text holds, one space apart, the words that no run
    contains after its first period.  `edit` may change a document's words beforehand,
    given its id.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text", 1 << 20):
            ids = b.column("doc_id").to_pylist() if edit else [None] * b.num_rows
            docs_words = [t.encode().split() for t in b.column("text").to_pylist()]
            if edit:
                docs_words = [edit(i, w) for i, w in zip(ids, docs_words)]
            codes: dict[bytes, int] = {}
            sizes = np.fromiter(map(len, docs_words), np.int64, len(docs_words))
            starts = np.cumsum(sizes + 1) - sizes - 1
            x = np.empty(int((sizes + 1).sum()), np.int64)
            for at, w in zip(starts.tolist(), docs_words):
                x[at: at + len(w)] = [codes.setdefault(k, len(codes)) for k in w]
            x[starts + sizes] = len(codes) + np.arange(len(sizes))  # separators occur once
            found = find_runs(x, int(sizes.max()))
            listed: list[list[dict]] = [[] for _ in docs_words]
            gone = np.zeros(len(x) + 1, np.int32)
            for s, e, q in found:
                doc = int(np.searchsorted(starts, s, "right")) - 1
                listed[doc].append({"start": s - int(starts[doc]), "length": e - s, "period": q})
                gone[s + q] += 1
                gone[e] -= 1
            gone = np.cumsum(gone) > 0
            kept = []
            for at, w, r in zip(starts.tolist(), docs_words, listed):
                if r:
                    w = [w[k] for k in np.flatnonzero(~gone[at: at + len(w)]).tolist()]
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(listed, run_type), pa.array(kept, pa.string())], names=["doc_id", "runs", "text"])

    return source.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string")


def digests(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's columns and the digests of the runs and of the text."""
    # longest first, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    r = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "text")
    return r.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.encode("lines", "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("collapsed_sha256"))
