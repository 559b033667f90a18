"""Vectorised words and rolling hashes over Arrow string batches.

A word is a maximal run of bytes other than space and 0x09-0x0D.  UTF-8 never
uses those bytes inside a longer character, so whole batches are cut at byte
level without decoding.  Hashes are polynomials modulo 2**64 (Rabin-Karp),
finished with a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, WINDOW_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64 and of its inverse."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, n + n // 8)
        inverse = U(pow(int(base), -1, 1 << 64))
        tables = []
        for b in (base, inverse):
            t = np.full(size, b, U)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = _powers[int(base)] = (tables[0], tables[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look independent."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of some rows: data holds the rows' bytes one after another, row r
    is data[rows[r]:rows[r+1]] and has the words first[r] .. first[r+1]-1; word
    w is data[starts[w]:ends[w]]."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, block: int = 1 << 18) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), U)
        at = 0
        while at < len(out):
            lo = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, lo + block, "right")))
            hi = self.ends[to - 1]
            up, down = powers(BASE, hi - lo + 1)
            total = np.zeros(hi - lo + 1, U)
            np.cumsum((self.data[lo:hi].astype(U) + U(1)) * up[:-1], out=total[1:])
            s, e = self.starts[at:to] - lo, self.ends[at:to] - lo
            out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * WINDOW_BASE)
            at = to
        return out

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each run of width words inside one row, bounds): row r has
        the runs bounds[r] .. bounds[r+1]-1, by start."""
        n = np.maximum(np.diff(self.first) - width + 1, 0)
        bounds = np.concatenate(([0], np.cumsum(n)))
        if not bounds[-1]:
            return np.empty(0, U), bounds
        up, down = powers(WINDOW_BASE, len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * up[:-1], out=total[1:])
        at = np.arange(bounds[-1]) + np.repeat(self.first[:-1] - bounds[:-1], n)
        return mix((total[at + width] - total[at]) * down[at] + U(width)), bounds


def cut(texts: pa.Array, fold: bool = False) -> Words:
    """The words of each text; fold lower-cases A-Z; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint8), np.zeros(1, np.int64), none, none, np.zeros(1, np.int64))
    rows = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]]
    rows = rows - rows[0]
    if fold:
        data = FOLD[data]
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = rows[(rows > 0) & (rows < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, rows, starts, ends, np.searchsorted(starts, rows))


def pieces(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes (one row at least), so that memory
    follows the longest text and not the size of an Arrow batch."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.binary_length(texts).fill_null(0))
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield a, b
