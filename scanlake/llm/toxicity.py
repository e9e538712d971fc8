"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams inside its words (lower case, words
padded with a blank on both sides), hashed into a fixed number of slots.  A slot's value
is the log-count ratio r of the labelled classes, so that a logistic regression on these
values starts from the naive Bayes decision.  Distinct n-grams of a text are the union of
those of its distinct words, which lets each word's n-grams be computed once and kept.
Only slots whose ratio is clearly not 0 take part.

Null and empty texts have no n-gram and get the score of the intercept.  Repeated rows
get equal scores; labels of repeated ids count once each; no labelled row at all gives
every text the score of the labels' share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import held_out, in_slices, smallest_by_hash, whole_text

SLOTS = 1 << 20
SIZES = (3, 4, 5, 6, 7, 8)
#: Most labelled rows of each class that the fit uses.
SAMPLE_PER_CLASS = 1500
#: Pseudo-documents of the log-count ratio, dealt to the classes by their share.
SMOOTH = 3.0
#: A slot takes part if its ratio differs from 0 by so many standard deviations.
CLEAR = 4.0
_SEEN: dict[tuple[int, str], tuple[int, ...]] = {}
_SEEN_MOST = 600_000


def word_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, slot) of every character n-gram of the words, blanks around them included."""
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = c == 32
    before = np.concatenate([[0], np.cumsum(blank)])
    own, slots = [], []
    for n in SIZES:
        at = np.arange(max(0, len(c) - n + 1))
        inner = before[at + n - 1] - before[at + 1]
        at = at[inner == 0]
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ c[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        own.append(before[at + 1] - 1)
        slots.append((h >> np.uint64(20)) % np.uint64(SLOTS))
    return np.concatenate(own).astype(np.int64), np.concatenate(slots).astype(np.int32)


def text_slots(text: str) -> np.ndarray:
    """Distinct slots of one text."""
    words = list(set(text.lower().split()))
    return np.unique(word_slots(words)[1]) if words else np.zeros(0, np.int32)


def fit(rows: list[np.ndarray], y: np.ndarray, prior: float, rounds: int = 600, decay: float = 1e-6) -> tuple[dict[int, float], float]:
    """Weight by slot (log-count ratio times the regression's weight) and intercept.

    `prior` is the share of label 1 outside the sample; it shifts the intercept.
    """
    if not len(y) or y.min() == y.max():
        return {}, float(np.log((prior + 1e-9) / (1 - prior + 1e-9)))
    n1, n0 = y.sum(), (1 - y).sum()
    one, two = np.full(SLOTS, SMOOTH * n1 / len(y)), np.full(SLOTS, SMOOTH * n0 / len(y))
    for r, t in zip(rows, y, strict=True):  # a row's slots are distinct
        (one if t else two)[r] += 1
    ratio = np.log(one / n1) - np.log(two / n0)
    clear = np.abs(ratio) > CLEAR * np.sqrt(1 / one + 1 / two)
    rows = [r[clear[r]] for r in rows]
    own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, idx = np.unique(np.concatenate(rows), return_inverse=True)
    scale = max(1.0, np.sqrt((ratio[used] ** 2).mean() if len(used) else 1.0) * np.sqrt(max(1.0, len(idx) / len(rows))))
    x = ratio[used][idx] / scale
    w = np.zeros(len(used))
    b = float(np.log(n1 / n0))
    ahead, ahead_b, last, last_b = w, b, w, b
    for t in range(1, rounds + 1):
        z = np.bincount(own, ahead[idx] * x, len(rows)) + ahead_b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        w = ahead - 4.0 * (np.bincount(idx, g[own] * x, len(used)) + decay * ahead)
        b = ahead_b - 4.0 * g.sum() / 4
        k = (t - 1) / (t + 2)
        ahead, ahead_b, last, last_b = w + k * (w - last), b + k * (b - last_b), w, b
    b += np.log((prior + 1e-6) / (1 - prior + 1e-6)) - np.log(n1 / n0)
    return dict(zip(used.tolist(), (w * ratio[used] / scale).tolist(), strict=True)), float(b)


def features(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep` columns and the distinct slots of each text as packed 32-bit integers."""
    source = docs.select(*keep, whole_text(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", slots binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "_text"):
            out = [text_slots(t).tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[*b.schema.names[:-1], "slots"])

    return source.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text") -> tuple[dict[int, float], float]:
    """Fit on labelled rows: at most SAMPLE_PER_CLASS of each class, chosen by a hash of the id."""
    y = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").distinct()
    n = dict(y.groupBy("_y").count().collect())
    chosen = smallest_by_hash(y.filter("_y = 1"), SAMPLE_PER_CLASS, "_id").union(smallest_by_hash(y.filter("_y = 0"), SAMPLE_PER_CLASS, "_id"))
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")  # bounded: SAMPLE_PER_CLASS rows a class
    got = features(joined, "_t", "_y", "_id").orderBy("_id", "slots").toPandas()
    rows = [np.frombuffer(s, np.int32) for s in got["slots"]]
    prior = n.get(1, 0) / max(1, sum(n.values())) if n else 0.5
    return fit(rows, got["_y"].to_numpy(float), prior)


def score(docs: DataFrame, model: tuple[dict[int, float], float], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, score (0 to 1)."""
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("_text"))
    spark = docs.sparkSession
    kind = source.schema["doc_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(model)  # bounded: SLOTS weights
    version = id(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        known = np.zeros(SLOTS, bool)
        known[list(weights)] = True
        for b in in_slices(batches, "_text"):
            texts = [set(t.lower().split()) for t in b.column("_text").to_pylist()]
            new = [w for w in set().union(*texts) if (version, w) not in _SEEN]
            if len(_SEEN) + len(new) > _SEEN_MOST:
                _SEEN.clear()
                new = list(set().union(*texts))
            for lo in range(0, len(new), 50_000):
                some = new[lo: lo + 50_000]
                own, slots = word_slots(some)
                hit = known[slots]
                found: dict[int, tuple[int, ...]] = {}
                for i, k in zip(own[hit].tolist(), slots[hit].tolist(), strict=True):
                    found[i] = (*found.get(i, ()), k)
                _SEEN.update(((version, w), found.get(i, ())) for i, w in enumerate(some))
            out = []
            for words in texts:
                hits = set()
                for w in words:
                    if at := _SEEN[version, w]:
                        hits.update(at)
                out.append(bias + sum(weights[k] for k in sorted(hits)))
            s = 1 / (1 + np.exp(-np.clip(np.array(out), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learned from the rows not held out."""
    model = train(docs, labels.filter(~held_out("doc_id", mod, rest)), label)
    return score(docs, model).select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
