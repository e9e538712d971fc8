"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled good texts; unlabelled ones are texts of the corpus.  The
share of good texts among the unlabelled (the class prior) is estimated, then a small
network on text-shape features minimises

    prior * R+(positives as 1) + max(0, R-(unlabelled as 0) - prior * R-(positives as 0))

with the sigmoid loss; where the part in max() turns negative the step is taken against it.

Features of a text are shares of byte classes and single punctuation bytes, word length,
word repetition and length.  Null and empty texts have the features of an empty text.
Repeated rows get equal scores.  Without positives every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import held_out, in_slices, smallest_by_hash, whole_text

#: Most rows of either kind that the fit uses.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 4000, 8000
PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_LOWER, _UPPER, _DIGIT = np.arange(97, 123), np.arange(65, 91), np.arange(48, 58)
WIDTH = len(PUNCTUATION) + 12


def shape(text: str) -> np.ndarray:
    """The features of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(WIDTH)
    n = len(raw)
    if not n:
        return out
    h = np.bincount(raw, minlength=256) / n
    words = text.split()
    k = len(PUNCTUATION)
    out[:k] = np.sqrt(h[PUNCTUATION])
    w = max(1, len(words))
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:])) / w
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    out[k:] = (
        h[_LOWER].sum(), np.sqrt(h[_UPPER].sum()), np.sqrt(h[_DIGIT].sum()), h[128:].sum(), h[32], np.sqrt(h[10]),
        np.log1p(n) / 10, min(n / w, 40) / 10, np.log(distinct / w + 1e-3) / max(1.0, np.log(w + 1)), np.sqrt(again),
        np.log(pairs / max(1, len(words) - 1) + 1e-3), 1.0,
    )
    return out


def features(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep` columns and the features of each text as packed 32-bit floats."""
    source = docs.select(*keep, whole_text(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "x binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "_text"):
            x = [shape(t).astype(np.float32).tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.binary())], names=[*b.schema.names[:-1], "x"])

    return source.mapInArrow(run, schema)


class Model:
    """Standardised features, one hidden layer, one output."""

    def __init__(self, x: np.ndarray, hidden: int = 12, seed: int = 7):
        g = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 0.02
        self.p = [g.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), g.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.m = [np.zeros_like(a) for a in self.p]
        self.v = [np.zeros_like(a) for a in self.p]
        self.t = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ self.p[0] + self.p[1])
        return x, h, h @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(4 * self.forward(x)[2], -30, 30)))

    def gradient(self, x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        dh = np.outer(dz, self.p[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]

    def step(self, grad: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for i, g in enumerate(grad):
            g = g + 1e-4 * self.p[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def pu_fit(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, seed: int = 7) -> Model:
    """Minimise the non-negative risk by mini-batches."""
    model, g = Model(unl, seed=seed), np.random.default_rng(seed)
    for epoch in range(epochs):
        order = g.permutation(len(unl))
        for lo in range(0, len(order), batch):
            u = unl[order[lo: lo + batch]]
            p = pos[g.integers(0, len(pos), min(len(pos), batch))]
            xp, hp, zp = model.forward(p)
            xu, hu, zu = model.forward(u)
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
            negative = su.mean() - prior * sp.mean()  # sigmoid loss of calling a text bad is its s
            dsp, dsu = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
            if negative >= 0:
                grad_p, grad_u = -2 * prior * dsp, dsu
            else:
                grad_p, grad_u = prior * dsp, -dsu
            grad = [a + b for a, b in zip(model.gradient(xp, hp, grad_p), model.gradient(xu, hu, grad_u), strict=True)]
            model.step(grad, 0.01 if epoch < epochs // 2 else 0.003)
    return model


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 7) -> float:
    """Share of positives among the unlabelled, from the best top bin of a positive-unlabelled scorer.

    A scorer is fitted on one half; on the other half the share of unlabelled texts above a
    threshold over the share of positives above it bounds the prior, and the least such
    bound (with room for chance) is the estimate.
    """
    g = np.random.default_rng(seed)
    cut = lambda n: g.permutation(n) < n // 2
    cp, cu = cut(len(pos)), cut(len(unl))
    if cp.sum() < 2 or cu.sum() < 2:
        return 0.5
    model = pu_fit(pos[cp], unl[cu], 0.5, epochs=15)
    sp, su = np.sort(model.forward(pos[~cp])[2]), np.sort(model.forward(unl[~cu])[2])
    at = np.quantile(sp, np.linspace(0, 0.9, 181))
    above = lambda s: 1 - np.searchsorted(s, at) / len(s)
    p, u = above(sp), above(su)
    room = np.sqrt(np.log(20) / (2 * len(sp))) + np.sqrt(np.log(20) / (2 * len(su)))
    best = np.argmin((u + 0.25 * room) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.05, 0.98))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text") -> tuple[Model | None, float]:
    """Model and prior from labelled positives and a sample of all texts (bounds: SAMPLE_*)."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    good = labels.filter(F.col(label) == 1).select(F.col(id_col).alias("_id")).filter("_id is not null").distinct()
    chosen = smallest_by_hash(good, SAMPLE_POSITIVE, "_id")
    take = lambda d: np.frombuffer(b"".join(r[0] for r in features(d, "_t", "_id").orderBy("_id", "x").select("x").collect()), np.float32).reshape(-1, WIDTH).astype(float)
    pos = take(base.join(F.broadcast(chosen), "_id"))  # bounded: SAMPLE_POSITIVE rows
    if not len(pos):
        return None, 0.5
    unl = take(smallest_by_hash(base, SAMPLE_UNLABELLED, "_id"))
    prior = class_prior(pos, unl)
    return pu_fit(pos, unl, prior), prior


def score(docs: DataFrame, model: Model | None, name: str = "score", text: str = "text") -> DataFrame:
    """The rows of `docs` and their score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: a fixed number of weights

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        m = sent.value
        x = np.array([shape(t) for t in s], float).reshape(-1, WIDTH)
        return pd.Series(m.score(x) if m is not None and len(s) else np.full(len(s), 0.5))

    return docs.withColumn(name, run(whole_text(text)))


def quality(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learned from the rows not held out."""
    model, _ = train(docs, labels.filter(~held_out("doc_id", mod, rest)))
    return score(docs.select("doc_id", "text"), model, "score").select(
        "doc_id", held_out("doc_id", mod, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns; learned from all labelled positives."""
    model, _ = train(docs, labels)
    return score(docs, model, "_quality").filter("_quality >= 0.5").drop("_quality")
