"""Compact arrays for memory-mapped tables: packed integers and Elias-Fano sequences, vectorised.

An Elias-Fano sequence keeps n monotone numbers below u in about 2 + log2(u / n) bits
each: the low bits packed, the high bits as unary gaps in a bit vector with a rank
directory.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow.fs as pafs

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SELECT[_b, _k] = _p
del _b, _k, _p


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers below 2**bits (bits at most 56), end to end, as bytes with room to read 8 at any place."""
    if not bits or not len(values):
        return np.zeros(8, np.uint8)
    out, shifts = [], np.arange(bits, dtype=np.uint64)
    for lo in range(0, len(values), 1 << 16):  # a multiple of 8 numbers ends on a byte
        v = values[lo: lo + (1 << 16)].astype(np.uint64)
        out.append(np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


def unpack(raw: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.uint64)
    wide = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    bit = at.astype(np.uint64) * np.uint64(bits)
    return (wide[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7))) & np.uint64((1 << bits) - 1)


def elias_fano(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the sequence; `universe` is above the last value."""
    n = len(values)
    low = min(56, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))
    v = values.astype(np.uint64)
    high = (v >> np.uint64(low)).astype(np.int64)
    length = n + (int(max(0, universe - 1)) >> low) + 2
    upper = np.zeros((length + 63) // 64 * 8, np.uint8)
    pos = high + np.arange(n)
    np.bitwise_or.at(upper, pos >> 3, (1 << (pos & 7)).astype(np.uint8))
    ones = np.concatenate([[0], np.cumsum(_POP[upper].reshape(-1, 8).sum(1, dtype=np.int64))])
    return {"low": pack(v & np.uint64((1 << low) - 1), low), "upper": upper, "ones": ones, "head": np.array([n, low], np.int64)}


class EliasFano:
    def __init__(self, a: dict[str, np.ndarray], name: str = ""):
        self.low, self.upper, self.ones = (a[name + k] for k in ("low", "upper", "ones"))
        self.n, self.bits = (int(x) for x in a[name + "head"])
        self.zeros = 64 * np.arange(len(self.ones)) - self.ones

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: int) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero where flip is 255."""
        w = np.searchsorted(directory, k, "right") - 1
        rest = k - directory[w]
        raw = self.upper.reshape(-1, 8)[w] ^ np.uint8(flip)
        until = np.cumsum(_POP[raw], 1, dtype=np.uint8)
        j = np.minimum((until <= rest[:, None]).sum(1), 7)
        at = np.arange(len(k))
        byte = raw[at, j]
        return (w * 8 + j) * 8 + _SELECT[byte, np.minimum(rest - (until[at, j] - _POP[byte]), 7)]

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select(i, self.ones, 0) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | unpack(self.low, self.bits, i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number not below x (n if there is none)."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        most = 64 * (len(self.ones) - 1) - self.n - 1  # zeros there are, less one
        h = np.minimum((x >> np.uint64(self.bits)), np.uint64(most)).astype(np.int64)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, 255) - (h - 1), 0)
        lo = np.where(h > 0, lo, 0)
        hi = self._select(h, self.zeros, 255) - h
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        key = x & np.uint64((1 << self.bits) - 1)
        return search(lambda at: unpack(self.low, self.bits, at), lo, hi, key)


def search(read, lo: np.ndarray, hi: np.ndarray, key: np.ndarray) -> np.ndarray:
    """First place in [lo, hi) whose number, by read(places), is not below key; hi if there is none."""
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        below = read(mid) < key[live]
        lo[live] = np.where(below, mid + 1, lo[live])
        hi[live] = np.where(below, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays; a task that runs twice leaves one whole file."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    start = -(-(8 + len(text)) // 64) * 64
    own = f"{base}/{name}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as f:
        f.write((len(text).to_bytes(8, "little") + text).ljust(start, b"\0"))
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))
    fs.move(own, f"{base}/{name}")


def map_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped; a file of a remote store is copied to this worker's disk first."""
    fs, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    if not isinstance(fs, pafs.LocalFileSystem):
        import tempfile

        local = f"{tempfile.gettempdir()}/{base.rsplit('/', 1)[-1]}-{uuid.uuid4().hex}-{name}"
        pafs.copy_files(f"{folder}/{name}", f"file://{local}")
        path = local
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[:8].view("<u8")[0])
    head = json.loads(raw[8: 8 + n].tobytes())
    start = -(-(8 + n) // 64) * 64
    return {k: np.frombuffer(raw, np.dtype(t), c, start + at) if c else np.zeros(0, np.dtype(t)) for k, (t, c, at) in head.items()}
