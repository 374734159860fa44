"""Vectorised text kernels shared by the corpus operators.

Texts reach Python as Arrow batches.  The kernels work on the concatenated
UTF-8 bytes of a run of rows, so one NumPy call serves many documents; a run
is bounded by ``CHUNK_BYTES`` unless one text alone is longer, so a worker needs some
hundred bytes of arrays for each byte of that bound, or of its longest text.

Fingerprints of ranges are polynomials modulo 2**64.  Such sums alone collide on
Thue-Morse sequences of two symbols, whatever the base; so words and byte strings are
first rewritten as mixed values of neighbouring pairs or eights of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 512 << 10
U64 = np.uint64

#: Odd multipliers of the two rolling fingerprints (any odd 64-bit numbers do).
BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64); a bijection, so equal only for equal inputs."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random-looking 64-bit number for each byte value.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U64(BASE[0]))

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, n of each at least."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = BASE[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                np.multiply(p[:step], U64(pow(b, done, 1 << 64)), out=p[done : done + step])
                done += step
            out.append(p)
        have = _POWERS[which] = (out[0], out[1])
    return have


class Rolling:
    """Fingerprints of ranges of a sequence of 64-bit unit values."""

    def __init__(self, x: np.ndarray, which: int):
        n = len(x)
        up, self.down = powers(which, n + 1)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(x * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One value for each range [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """One value for each range of k units, by its start."""
        n = len(self.sums) - 1 - k + 1
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + U64(k)) if n > 0 else np.empty(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (w - span)], m[w - span :]) if w > span else m


# ---------------------------------------------------------------- Arrow rows


def runs(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


# --------------------------------------------------------------------- words

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that are cut at white space: all but blank and 09-0D.
WORD_SPACE = ~SPACE
#: Bytes of words of letters and digits: 0-9, a-z after lower-casing, and all beyond ASCII.
WORD_ALNUM = np.zeros(256, bool)
WORD_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray = WORD_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each row's words begin in them."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[buf]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] = inside[1:-1][edges]
    closes[edges - 1] = inside[1:-1][edges - 1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(start, off)


#: A random-looking 64-bit number for each pair of neighbouring bytes, the first one low.
PAIR_VALUE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * U64(BASE[1]))


def word_values(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit value of each word, the same wherever the word stands: its pairs of bytes and its last byte."""
    if not len(start):
        return np.empty(0, np.uint64)
    b = (LOWER[buf] if lower else buf).astype(np.uint16)
    pairs = Rolling(PAIR_VALUE[b[:-1] | (b[1:] << np.uint16(8))], 0).of(start, end - 1)
    return mix(pairs ^ BYTE_VALUE[b[end - 1]])


#: Bytes that one value of ``byte_eights`` speaks for.
EIGHT = 8


def byte_eights(buf: np.ndarray) -> np.ndarray:
    """A 64-bit value of the eight bytes from each byte on; different eights have different values."""
    padded = np.concatenate([buf, np.zeros(EIGHT, np.uint8)])
    return mix(np.ndarray(len(buf), "<u8", padded, 0, (1,)).astype(np.uint64))


def as_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """One list for each count, cut from the values in turn."""
    cuts = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=cuts[1:])
    return pa.ListArray.from_arrays(pa.array(cuts), values if isinstance(values, pa.Array) else pa.array(values))
