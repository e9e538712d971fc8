"""N-gram Jaccard join: word five-gram sets, MinHash candidates, Bayesian pruning, exact check.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at
least THRESHOLD.  Texts with equal content are one class and are never compared.

1. Every distinct text gets BANDS * ROWS MinHash values.  Texts that agree in a band are
   candidates: a pair of similarity 0.8 meets in some band with probability 0.99995.
2. In a bucket, pairs are compared chunk by chunk of MinHash values; after each chunk a
   pair is dropped if, by the posterior of its similarity (uniform prior), the probability
   of reaching the threshold is below TOLERANCE.  What is left joins texts to groups.  A
   bucket gives a spanning forest of its pairs, not the pairs.
3. Within a group all pairs go through the same pruning and then an exact comparison of
   their shingle sets.  Again only counts of links a text and a spanning forest leave.

Large buckets and groups are cut into blocks of BLOCK texts; each pair of blocks is a task
of its own, so that no task holds more than two blocks.

Texts of one to four words have one shingle, the whole text; null and empty texts have
none and are linked to nothing (equal ones are still one class).  Repeated rows belong to
one class.  Words are split at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import components, hold, in_slices, run_borders, sorted_runs, stage, text_key, whole_text

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
TOLERANCE = 1e-6
CHUNK = 25
BLOCK = 128
_M = BANDS * ROWS
_G = np.random.default_rng(23)
_A = _G.integers(1, 1 << 63, _M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _G.integers(1, 1 << 63, _M, dtype=np.uint64)
_HASH: dict[str, int] = {}
_HASH_MOST = 200_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, end to end, and the borders of the texts in them."""
    words = [t.split() for t in texts]
    flat = [w for ws in words for w in ws]
    new = {w for w in flat if w not in _HASH}
    if len(_HASH) + len(new) > _HASH_MOST:
        _HASH.clear()
        new = set(flat)
    _HASH.update((w, xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
    h = np.fromiter(map(_HASH.__getitem__, flat), np.uint64, len(flat))
    n = np.array([len(ws) for ws in words], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    borders = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - borders[:-1], count) + np.arange(borders[-1])
    end = np.repeat(first[1:], count)
    s = np.full(len(at), 1, np.uint64)
    for j in range(WORDS):
        i = at + j
        s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + np.where(i < end, h[np.minimum(i, max(0, len(h) - 1))] if len(h) else np.uint64(0), np.uint64(j)))
    return s, borders


def minhashes(s: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """(texts, values) for texts that all have shingles."""
    out = np.empty((len(borders) - 1, _M), np.uint32)
    for j in range(_M):
        out[:, j] = np.minimum.reduceat(((s * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), borders[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = []
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
        keys.append(h)
    return np.array(keys).T.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of compared values: matches below which a pair is dropped."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(CHUNK, _M + 1, CHUNK):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(logs - logs.max())
            if p[grid >= threshold].sum() / p.sum() >= tolerance:
                out[n] = m
                break
    return out


_LEAST = least_matches()


def likely(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) of rows may still reach the threshold after all chunks."""
    live, match = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n in range(CHUNK, _M + 1, CHUNK):
        part = slice(n - CHUNK, n)
        match = match + (sig[a[live], part] == sig[b[live], part]).sum(1)
        ok = match >= _LEAST[n]
        live, match = live[ok], match[ok]
    return live


def pairs_of_runs(borders: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (a < b) within the runs, a bounded number at a time."""
    size = np.diff(borders)
    place = np.arange(borders[-1]) - np.repeat(borders[:-1], size)
    cut = np.concatenate([[0], np.cumsum(place)])  # row i has place[i] partners before it
    lo = 0
    while lo < len(place):
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + 400_000, "right")) - 1)
        n = place[lo:hi]
        b = np.repeat(np.arange(lo, hi), n)
        start = np.repeat(np.arange(lo, hi) - n, n)
        a = start + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield a, b
        lo = hi


class Forest:
    """Union-find over rows; keeps the least row as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.array([self.root(i) for i in range(len(self.up))])
        i = np.flatnonzero(r != np.arange(len(r)))
        return i, r[i]


def signatures(texts: DataFrame) -> DataFrame:
    """key, sig, bands of texts (columns key and _text) that have shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_duplicates", _HASH.clear)
        for b in in_slices(batches, "_text"):
            s, borders = shingles(b.column("_text").to_pylist())
            some = np.flatnonzero(np.diff(borders))
            if not len(some):
                continue
            sig = minhashes(s, np.concatenate([borders[some], borders[-1:]]))
            bands = band_keys(sig)
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(some)), pa.array([r.tobytes() for r in sig], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))],
                names=["key", "sig", "bands"])

    return texts.mapInArrow(run, "key binary, sig binary, bands array<long>")


def in_blocks(members: DataFrame, by: str) -> DataFrame:
    """Rows (by, n, key) copied to the pairs of blocks they take part in: columns by, i, j, key."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("own", own)
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.select(by, F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "key")


def candidate_edges(sigs: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the likely pairs of every bucket."""
    bands = sigs.select("key", F.explode("bands").alias("band"))
    full = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    rows = in_blocks(bands.join(full, "band"), "band").join(sigs.select("key", "sig"), "key")
    rows = rows.select("band", "i", "j", "key", "sig").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, ["band", "i", "j"], 10_000):
            key = t.column("key").combine_chunks()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, _M)
            forest = Forest(t.num_rows)
            for a, b in pairs_of_runs(run_borders(t, ["band", "i", "j"])):
                ok = likely(sig, a, b)
                forest.join(a[ok], b[ok])
            i, r = forest.edges()
            yield pa.RecordBatch.from_arrays([key.take(pa.array(i)), key.take(pa.array(r))], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """For each two of the sets the number of shingles in both (the diagonal does not count single ones)."""
    kinds, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = n[at] > 1  # a shingle of one set is shared by no pair
    row, at = row[several], (np.cumsum(n > 1) - 1)[at[several]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, (16 << 20) // len(sets))
    order = np.argsort(at, kind="stable")
    bases = range(0, int((n > 1).sum()), step)
    cut = np.searchsorted(at[order], [*bases, len(kinds)])
    for lo, hi, base in zip(cut, cut[1:], bases):
        m = np.zeros((len(sets), min(step, int(at[order[hi - 1]]) + 1 - base)), np.float32)
        m[row[order[lo:hi]], at[order[lo:hi]] - base] = 1
        both += m @ m.T
    return both


def exact_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which pairs (by ascending b, both of one run) of sorted distinct shingle sets reach the threshold."""
    size = np.array([len(s) for s in sets])
    need = np.ceil(THRESHOLD / (1 + THRESHOLD) * (size[a] + size[b]) - 1e-9)
    out = np.zeros(len(a), bool)
    could = np.flatnonzero(np.minimum(size[a], size[b]) >= need)
    cut = np.searchsorted(b[could], borders)
    # run by run: sets of different runs are never compared
    for r in np.flatnonzero(np.diff(cut)):
        lo, hi, some = borders[r], borders[r + 1], could[cut[r]: cut[r + 1]]
        if len(some) > 4 * (hi - lo) and hi - lo > 8:
            out[some] = shared_counts(sets[lo:hi])[a[some] - lo, b[some] - lo] >= need[some]
            continue
        for k in some:
            x, y = sets[a[k]], sets[b[k]]
            if len(x) > len(y):
                x, y = y, x
            i = np.searchsorted(y, x)
            out[k] = (y[np.minimum(i, len(y) - 1)] == x).sum() >= need[k]
    return out


def verified(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """key, links, root: exact links of a text in a pair of blocks, and the least text it is joined to there."""
    n = groups.groupBy("root").agg(F.count("*").alias("n"))
    members = in_blocks(groups.withColumnRenamed("node", "key").join(n, "root"), "root")
    rows = members.join(texts, "key").select("root", "i", "j", "own", "key", "_text")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_duplicates", _HASH.clear)
        for t in sorted_runs(batches, ["root", "i", "j"], 256):
            key, own = t.column("key").combine_chunks(), t.column("own").to_numpy()
            cross = t.column("i").to_numpy() != t.column("j").to_numpy()
            s, borders = shingles(t.column("_text").to_pylist())
            sig = minhashes(s, borders)
            sets = [np.unique(s[lo:hi]) for lo, hi in zip(borders, borders[1:])]
            links, forest = np.zeros(t.num_rows, np.int64), Forest(t.num_rows)
            runs = run_borders(t, ["root", "i", "j"])
            for a, b in pairs_of_runs(runs):
                new = ~cross[a] | (own[a] != own[b])  # pairs within a block are another task's
                a, b = a[new], b[new]
                ok = likely(sig, a, b)
                a, b = a[ok], b[ok]
                ok = exact_links(sets, a, b, runs)
                a, b = a[ok], b[ok]
                links += np.bincount(a, minlength=len(links)) + np.bincount(b, minlength=len(links))
                forest.join(a, b)
            some = np.flatnonzero(links)
            root = np.array([forest.root(int(i)) for i in some], np.int64)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(some)), pa.array(links[some]), key.take(pa.array(root))], names=["key", "links", "root"])

    return rows.mapInArrow(run, "key binary, links long, root binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, copy_id (least id of the equal texts), class_id (least id of the linked
    texts), links (different texts linked to this one), class_key (least text key of the class).

    class_key names a class.  Ids do not: unrelated texts may share one, or have none.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("_text")).select(text_key(F.col("_text")).alias("key"), "doc_id", "_text")
    sigs = stage(signatures(t).groupBy("key").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")), "signatures")
    groups = stage(components(candidate_edges(sigs)), "groups")
    # one row of each text, found without bringing its copies together
    ids = stage(t.groupBy("key").agg(F.min("doc_id").alias("copy_id")), "copies")
    wanted = ids.join(groups.select(F.col("node").alias("key")), "key").select("key", F.col("copy_id").alias("doc_id"))
    one = t.join(wanted.withColumnRenamed("key", "_k"), (F.col("key") == F.col("_k")) & t["doc_id"].eqNullSafe(wanted["doc_id"])).select("key", "_text").dropDuplicates(["key"])
    found = stage(verified(groups, one), "links")
    classes = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    least = ids.join(classes.withColumnRenamed("node", "key"), "key")
    class_ids = least.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    info = ids.join(least.select("key", "root").join(class_ids, "root"), "key", "left").join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
    info = info.select("key", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("class_key"))
    return t.select("key", "doc_id").join(info, "key").select("doc_id", "key", "copy_id", "class_id", "links", "class_key")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the least id (a null id is the last), with its columns.

    Rows of the chosen id and text that are repeated stay one.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m")
    best = near_duplicates(docs).groupBy("class_key").agg(first).select(F.col("m.doc_id").alias("_id"), F.col("m.key").alias("_key"))
    t = docs.withColumn("_k", text_key(whole_text("text")))
    return t.join(best, (t["_k"] == best["_key"]) & t["doc_id"].eqNullSafe(best["_id"])).dropDuplicates(["_k", "doc_id"]).select(*docs.columns)
