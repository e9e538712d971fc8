"""Cross-tokenizer alignment: token groups and links of two tokenizers by interval coalescing.

Tokenizer A encodes space + text, tokenizer B the text (and adds the space itself).  Both
cut the same bytes into tokens, which are intervals.  All A and B tokens are sorted by start
(`lexsort`) and the running maximum of their ends is taken (`maximum.accumulate`): a group
breaks where a start reaches that maximum.  Within groups the overlaps are expanded: the
tokens that stand open at each distinct start are one link, and every overlapping pair of
occurrences has exactly one such start.

How often an id pair is linked in the whole corpus decides which links are best.  A task
gathers the documents of about SLICE bytes into one row with their links and with the distinct
id pairs of those links.  Spark sums the pairs, takes the highest count of every B id, and
joins both back to the pairs of each row, so that a row gets the counts of its own pairs
only: nothing that grows with the corpus is held in a task, sent to the driver or broadcast.

Null and empty texts, and texts that a tokenizer does not give back byte for byte (B reads
U+2581 as a space), have no tokens: zeros and an empty `groups_sha256`.  Strings of special
tokens are plain text.  A long text is encoded in pieces that end before a lone space, where
both tokenizers cut anyway; its tokens are held in its task, everything else goes piece by
piece.  Repeated rows count each for itself, an empty table gives an empty result, and
columns of `docs` other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import hold, in_slices, stage, whole_text

SLICE = 384 << 10
PIECE = 64 << 10
BATCH = 128 << 10
#: An id pair is one number: A's id times 2^B_BITS, plus B's id.
B_BITS = 15
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A's own cut into words, for texts of the characters below; others go to the tokenizer whole.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^\n -~{_LETTER}]")
#: Words are looked up where they are short; at most so many.
_SHORT, _KNOWN_MOST = 48, 300_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        n = self.b.get_piece_size()
        if n > 1 << B_BITS or len(self.a_bytes) > 1 << (31 - B_BITS):
            raise ValueError("a vocabulary is too large for the id pairs")
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.a_size, self.b_size = (np.fromiter(map(len, t), np.int32, len(t)) for t in (self.a_bytes, self.b_bytes))
        # what is written for a token: its id and the sign behind it, by what follows
        self.written = [f"{i}{sign}".encode() for ids, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for sign in signs for i in range(len(ids))]
        self.known: dict[str, bytes] = {}

    def _encode(self, strings: list[str]) -> Iterator[bytes]:
        for e in self.a.encode_batch_fast(strings, add_special_tokens=False) if strings else ():
            yield struct.pack(f"<{len(e)}i", *e.ids)

    def encode_a(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of A; words met before are looked up, the new ones are encoded in one call."""
        words = [None if _OTHER.search(t) else _WORDS.findall(t) for t in pieces]
        if len(self.known) > _KNOWN_MOST:
            self.known.clear()
        new = list(set().union(*filter(None, words)).difference(self.known))
        self.known.update(zip(new, self._encode(new), strict=True))
        whole = self._encode([t for t, w in zip(pieces, words) if w is None])
        out = [np.frombuffer(next(whole) if w is None else b"".join(map(self.known.__getitem__, w)), np.int32) for w in words]
        for w in new:
            if len(w) > _SHORT:
                del self.known[w]
        return out

    def encode_b(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of B; a piece begins with the space that B adds."""
        return [np.array(ids, np.int32) for ids in self.b.encode([p[1:] for p in pieces], num_threads=1)]


_PAIR: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    hold("alignment", _PAIR.clear)
    if (a_path, b_path) not in _PAIR:
        _PAIR.clear()
        _PAIR[a_path, b_path] = Pair(a_path, b_path)
    return _PAIR[a_path, b_path]


def cut(text: str, most: int = PIECE) -> list[str]:
    """Pieces of space + text that are tokenized on their own; each begins with a space."""
    text = " " + text
    out, at = [], 0
    while len(text) - at > most:
        end = _CUT.search(text, at + most)
        if end is None:
            break
        out.append(text[at: end.start()])
        at = end.start()
    return [*out, text[at:]]


def coalesce(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups and links of two rows of tokens over the same bytes, given the tokens' sizes.

    Returns, for the tokens sorted by start: place in the own row, side (0 A, 1 B), start
    and group; and for the links: place in A's row, place in B's row, start.
    """
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    start = np.concatenate([a_end - a_size, b_end - b_size])
    end = np.concatenate([a_end, b_end])
    side = np.repeat(np.array([0, 1], np.int8), [len(a_size), len(b_size)])
    place = np.concatenate([np.arange(len(a_size)), np.arange(len(b_size))])
    order = np.lexsort((side, start))
    start, end, side, place = start[order], end[order], side[order], place[order]
    high = np.maximum.accumulate(end)
    group = np.concatenate([[0], np.cumsum(start[1:] >= high[:-1])]) if len(start) else np.zeros(0, np.int64)
    ends_start = np.append(start[1:] != start[:-1], True) if len(start) else np.zeros(0, bool)
    open_a, open_b = np.cumsum(side == 0) - 1, np.cumsum(side == 1) - 1
    return place, side, start, group, open_a[ends_start], open_b[ends_start], start[ends_start]


def group_codes(ids: np.ndarray, side: np.ndarray, group: np.ndarray, a_ids: int, b_ids: int) -> np.ndarray:
    """Places in `Pair.written` of tokens ordered by group, then side: which sign follows each."""
    goes_on = np.append((side[1:] == side[:-1]) & (group[1:] == group[:-1]), False)
    return ids + np.where(side == 0, np.where(goes_on, 0, a_ids), 2 * a_ids + np.where(goes_on, 0, b_ids))


class Document:
    """Sums of one document, filled piece by piece."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.sha, self.sign = hashlib.sha256(), b""

    def add(self, written: bytes) -> None:
        self.sha.update(self.sign + written[:-1])
        self.sign = written[-1:]

    def digest(self) -> str:
        return self.sha.hexdigest() if self.n_a else ""


def align_pieces(both: Pair, pieces: list[tuple[Document, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Add pieces (document, A's ids, B's ids) to their documents; returns the id pairs of all links in order."""
    a, b = np.concatenate([p[1] for p in pieces]), np.concatenate([p[2] for p in pieces])
    place, side, start, group, link_a, link_b, link_start = coalesce(both.a_size[a], both.b_size[b])
    sizes = [int(both.a_size[p[1]].sum()) for p in pieces]
    ends = np.cumsum(sizes)
    by_group = np.argsort(group * 2 + side, kind="stable")
    ids = np.where(side == 0, a[np.minimum(place, len(a) - 1)], b[np.minimum(place, len(b) - 1)])
    codes = group_codes(ids[by_group], side[by_group], group[by_group], len(both.a_bytes), len(both.b_bytes)).tolist()
    tokens = np.concatenate([[0], np.searchsorted(start, ends)]).tolist()
    links = np.concatenate([[0], np.searchsorted(link_start, ends)]).tolist()
    for i, (doc, own_a, own_b) in enumerate(pieces):
        lo, hi = tokens[i], tokens[i + 1]
        doc.n_a += len(own_a)
        doc.n_b += len(own_b)
        doc.n_groups += int(group[hi - 1] - group[lo]) + 1
        doc.n_links += links[i + 1] - links[i]
        doc.add(b"".join(map(both.written.__getitem__, codes[lo:hi])))
    return (a[link_a] << B_BITS) | b[link_b]


def align_texts(both: Pair, texts: list[str]) -> tuple[list[Document], np.ndarray]:
    """Documents of texts, and the id pairs of all their links in order."""
    cuts = [cut(t) if t else [] for t in texts]
    pieces = [p for c in cuts for p in c]
    a, b = both.encode_a(pieces), both.encode_b(pieces)
    right = []
    for p, x, y in zip(pieces, a, b):
        raw = p.encode()
        right.append(b"".join(map(both.a_bytes.__getitem__, x.tolist())) == raw and b"".join(map(both.b_bytes.__getitem__, y.tolist())) == raw)
    docs, links, held, size, at = [], [], [], 0, 0
    for c in cuts:
        docs.append(Document())
        if all(right[at: at + len(c)]):
            for k in range(at, at + len(c)):
                held.append((docs[-1], a[k], b[k]))
                size += len(a[k])
                if size > PIECE:
                    links.append(align_pieces(both, held))
                    held, size = [], 0
        at += len(c)
    if held:
        links.append(align_pieces(both, held))
    return docs, np.concatenate(links) if links else np.zeros(0, np.int32)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def place_type(pairs: int) -> str:
    """The numbers that name a place among so many pairs."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


def aligned_slices(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text", most: int = SLICE) -> DataFrame:
    """One row a slice: its documents in order (ids, counts, digests), `links` (places in
    `pairs`, packed), and its distinct id pairs with how often each is linked here."""
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    kind = source.schema["doc_id"]
    fields = ", ".join(f"{c} array<bigint>" for c in _COUNTS)
    schema = f"slice long, doc_id array<{kind.dataType.simpleString()}>, {fields}, groups_sha256 array<string>, links binary, pairs array<int>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, made = pair_of(a_path, b_path), TaskContext.get().partitionId() << 32

        def row(ids, done, links) -> pa.RecordBatch:
            pairs, at, times = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            lists = [[[getattr(d, c) for d in done]] for c in _COUNTS]
            ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array(x, pa.list_(pa.int64())) for x in lists],
                pa.array([[d.digest() for d in done]], pa.list_(pa.string())), pa.array([at.astype(place_type(len(pairs))).tobytes()], pa.binary()),
                pa.array([pairs.astype(np.int32)], pa.list_(pa.int32())), pa.array([times.astype(np.int32)], pa.list_(pa.int32()))],
                names=["slice", "doc_id", *_COUNTS, "groups_sha256", "links", "pairs", "times"])

        ids, done, links, size = [], [], [], 0
        for b in in_slices(batches, "text", min(most, BATCH)):
            found, new = align_texts(both, b.column("text").to_pylist())
            ids.append(b.column("doc_id"))
            done += found
            links.append(new)
            size += b.column("text").nbytes
            if size >= most:
                yield row(ids, done, links)
                ids, done, links, size, made = [], [], [], 0, made + 1
        if done:
            yield row(ids, done, links)

    return source.mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text", most: int = SLICE) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    slices = stage(aligned_slices(docs, a_path, b_path, id_col, text, most), "slices")
    kind = slices.schema["doc_id"].dataType.elementType.simpleString()
    counts = slices.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("count"))
    counts = stage(counts.withColumnRenamed("pairs", "pair").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))), "pair_counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    known = counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    asked = slices.select("slice", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(known, "pair").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("known"))
    answers = answers.select("slice", F.col("known.count").alias("counts"), F.col("known.best").alias("best"))
    rows = slices.drop("pairs", "times").join(answers, "slice", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                own = {c: r.column(c).flatten() for c in ("doc_id", *_COUNTS, "groups_sha256")}
                links = np.frombuffer(r.column("links")[0].as_buffer(), place_type(len(r.column("counts").flatten())))
                ends = np.cumsum(own["n_links"].to_numpy())
                sums = []
                for c in ("best", "counts"):
                    values = r.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    total = np.concatenate([[0], np.cumsum(values[links])])[np.concatenate([[0], ends])]
                    sums.append(pa.array(np.diff(total)))
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], *[own[c] for c in _COUNTS], *sums, own["groups_sha256"]],
                    names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string")
