"""Language identification: a bidirectional gated recurrent network over bytes.

A text is read in segments: the runs between white space, cut after SEGMENT bytes.  One
gated recurrent network reads a segment's bytes forward, another backward; both states
together label every byte position.  A document's probabilities are the mean over all its
positions.  Segments that repeat are read once and counted.

Trained in numpy by backpropagation through time on a bounded sample (PER_LANGUAGE texts a
language).  Null texts and texts without a letter are `und` with score 1; empty tables
give empty results; repeated rows get equal results; with no language to learn every text
is `und`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import held_out, in_slices, whole_text

SEGMENT = 32
HIDDEN = 16
#: Most training texts of a language, and segments a fit sees.
PER_LANGUAGE, STEPS, BATCH = 200, 300, 192
UNDETERMINED = "und"
_SEEN: dict[tuple[int, str], np.ndarray] = {}
_SEEN_MOST = 250_000


def segments(text: str) -> list[str]:
    return text.split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class BiGru:
    """Parameters: per direction the byte table E (256 x 3H), U (H x 3H) and bias; output W (2H x L)."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 5):
        g = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        self.p = {}
        for d in "fb":
            self.p["E" + d] = g.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            self.p["U" + d] = (g.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.p["W"] = (g.normal(0, 1, (2 * hidden, len(labels))) / np.sqrt(hidden)).astype(np.float32)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction; x and mask are (T, B), read in the order of `d`."""
        H, E, U = self.h, self.p["E" + d], self.p["U" + d]
        T, B = x.shape
        h = np.zeros((B, H), np.float32)
        out = np.zeros((T, B, H), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            e, m = E[x[t]], mask[t][:, None]
            zr = sigmoid(e[:, : 2 * H] + h @ U[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(e[:, 2 * H:] + (r * h) @ U[:, 2 * H:])
            new = (h + z * (n - h)) * m + h * (1 - m)
            if keep is not None:
                keep.append((t, h, z, r, n, m))
            h = new
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(T, B, L): the label probabilities of every position."""
        s = np.concatenate([self.run(x, mask, "f"), self.run(x, mask, "b")], 2) @ self.p["W"] + self.p["c"]
        s = np.exp(s - s.max(2, keepdims=True))
        return s / s.sum(2, keepdims=True)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over positions, and its gradient by backpropagation through time."""
        H, p = self.h, self.p
        kept = {"f": [], "b": []}
        hf, hb = self.run(x, mask, "f", kept["f"]), self.run(x, mask, "b", kept["b"])
        both = np.concatenate([hf, hb], 2)
        s = both @ p["W"] + p["c"]
        s = np.exp(s - s.max(2, keepdims=True))
        q = s / s.sum(2, keepdims=True)
        n = mask.sum()
        at = np.arange(x.shape[1])
        loss = -(np.log(q[:, at, y] + 1e-9) * mask).sum() / n
        q[:, at, y] -= 1
        dq = q * (mask / n)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["W"] = np.einsum("tbh,tbl->hl", both, dq)
        g["c"] = dq.sum((0, 1))
        dh_all = dq @ p["W"].T
        for d, part in (("f", dh_all[:, :, :H]), ("b", dh_all[:, :, H:])):
            U, gU, gE = p["U" + d], g["U" + d], g["E" + d]
            back = np.zeros((x.shape[1], H), np.float32)
            for t, h, z, r, nn, m in reversed(kept[d]):
                dh = part[t] + back
                live = dh * m
                dn, dz = live * z * (1 - nn * nn), live * (nn - h) * z * (1 - z)
                drh = dn @ U[:, 2 * H:].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                gU[:, : 2 * H] += h.T @ dzr
                gU[:, 2 * H:] += (r * h).T @ dn
                np.add.at(gE, x[t], np.concatenate([dzr, dn], 1))
                back = dh * (1 - m) + live * (1 - z) + drh * r + dzr @ U[:, : 2 * H].T
        return float(loss), g


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) bytes and mask; 256 stands for no byte."""
    T = max(1, max((len(w) for w in words), default=1))
    x = np.full((len(words), T), 256, np.int64)
    size = np.array([len(w) for w in words])
    live = np.arange(T) < size[:, None]
    x[live] = np.frombuffer(b"".join(words), np.uint8)
    return x.T.copy(), live.T.astype(np.float32)


def fit(texts: list[tuple[str, str]], seed: int = 5) -> BiGru | None:
    """Train on (text, language) pairs; segments are drawn alike often for every language."""
    labels = sorted({y for _, y in texts})
    if not labels:
        return None
    pool = {y: [] for y in labels}
    for t, y in texts:
        for w in segments(t):
            raw = w.encode("utf-8", "surrogatepass")
            pool[y] += [raw[lo: lo + SEGMENT] for lo in range(0, len(raw), SEGMENT)]
    labels = [y for y in labels if pool[y]]
    if not labels:
        return None
    model, g = BiGru(labels, seed=seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in model.p.items()} for _ in "mv")
    each = max(1, BATCH // len(labels))
    for step in range(1, STEPS + 1) if len(labels) > 1 else ():
        words, y = [], []
        for i, name in enumerate(labels):
            words += [pool[name][k] for k in g.integers(0, len(pool[name]), each)]
            y += [i] * each
        _, grad = model.gradient(*padded(words), np.array(y))
        rate = 0.02 if step < STEPS * 0.6 else 0.006
        for k, a in grad.items():
            a = np.clip(a, -1, 1)
            m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.999 * v[k] + 0.001 * a * a
            model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def position_sums(model: BiGru, words: list[str]) -> np.ndarray:
    """(B, L + 1): sums of the label probabilities over each word's bytes, and its byte count."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    parts, own = [], []
    for i, w in enumerate(raw):
        for lo in range(0, max(1, len(w)), SEGMENT):
            parts.append(w[lo: lo + SEGMENT])
            own.append(i)
    out = np.zeros((len(words), len(model.labels) + 1))
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    for lo in range(0, len(order), 4096):
        some = order[lo: lo + 4096]
        x, mask = padded([parts[i] for i in some])
        q = (model.probabilities(x, mask) * mask[:, :, None]).sum(0)
        np.add.at(out, np.array([own[i] for i in some]), np.column_stack([q, mask.sum(0)]))
    return out


def label_spans(model: BiGru, text: str) -> list[tuple[int, int, str]]:
    """(first byte, end, language) runs of equally labelled positions of one text, white space left out."""
    spans: list[list] = []
    at = 0
    for w in segments(text):
        at = text.index(w, at)
        base, raw = len(text[:at].encode("utf-8", "surrogatepass")), w.encode("utf-8", "surrogatepass")
        for lo in range(0, len(raw), SEGMENT):
            x, mask = padded([raw[lo: lo + SEGMENT]])
            for j, k in enumerate(model.probabilities(x, mask)[:, 0].argmax(1)):
                if spans and spans[-1][1] == base + lo + j and spans[-1][2] == model.labels[k]:
                    spans[-1][1] += 1
                else:
                    spans.append([base + lo + j, base + lo + j + 1, model.labels[k]])
        at += len(w)
    return [tuple(s) for s in spans]


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> BiGru | None:
    """Fit on at most PER_LANGUAGE texts of each language, chosen by a hash of the id."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"), F.col(lang).cast("string").alias("_y")).filter("_y is not null and _t is not null")
    h = F.xxhash64("_id", "_y")
    # the k-th smallest hash of a language: kept as k buckets' minima, a bounded state a language
    least = d.groupBy("_y", F.pmod(h, F.lit(PER_LANGUAGE)).alias("slot")).agg(F.min(h).alias("_h"))
    chosen = d.withColumn("_h", h).join(F.broadcast(least.select("_y", "_h")), ["_y", "_h"])  # PER_LANGUAGE rows a language
    rows = chosen.dropDuplicates(["_y", "_h"]).orderBy("_y", "_h").select("_t", "_y").collect()
    return fit([(r[0], r[1]) for r in rows])


def predict(docs: DataFrame, model: BiGru | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, lang_pred, score."""
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: a fixed number of weights
    version = id(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in in_slices(batches, "_text"):
            lang, score = [], []
            counted = [Counter(segments(t)) for t in b.column("_text").to_pylist()]
            if m is not None:
                new = [w for w in set().union(*counted) if (version, w) not in _SEEN]
                if len(_SEEN) + len(new) > _SEEN_MOST:
                    _SEEN.clear()
                    new = list(set().union(*counted))
                for lo in range(0, len(new), 65536):
                    some = new[lo: lo + 65536]
                    _SEEN.update(zip(((version, w) for w in some), position_sums(m, some).astype(np.float32), strict=True))
            for c in counted:
                if m is None or not any(ch.isalpha() for w in c for ch in w):
                    lang.append(UNDETERMINED)
                    score.append(1.0)
                    continue
                s = np.array(list(c.values()), np.float64) @ np.array([_SEEN[version, w] for w in c])
                k = int(s[:-1].argmax())
                lang.append(m.labels[k])
                score.append(float(min(1.0, s[k] / s[-1])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language(docs: DataFrame, mod: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from the rows not held out."""
    model = train(docs.filter(~held_out("doc_id", mod, rest)))
    return predict(docs, model).select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "lang_pred", "score")
