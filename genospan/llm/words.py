"""Words of Arrow text columns as numpy arrays: borders, 64-bit hashes, window hashes.

A word is a longest run of bytes other than space and the control characters 9 to 13.
Texts are scanned whole, a bounded number of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from genospan.session import ship_by_value

ship_by_value(__name__)

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SCAN_BYTES = 1 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(_U64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 steps)."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U64(27))
    h = h * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    up = np.ones(1, dtype=_U64)
    down = np.ones(1, dtype=_U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SCAN_BYTES + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(size, base, dtype=_U64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, from prefix sums of a polynomial over random byte keys."""
    out = np.empty(len(starts), dtype=_U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SCAN_BYTES, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _Powers.of(b - a)
        sums = np.zeros(b - a + 1, dtype=_U64)
        np.cumsum(_BYTE_KEYS[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(_U64))
        lo = hi
    return out


def window_hashes(words: np.ndarray, width: int, seed: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words; borders of documents are up to the caller."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U64)
    acc = np.full(n, seed, dtype=_U64)
    factor = _U64(seed | 1)
    for k in range(width):
        acc *= factor
        acc += words[k : k + n]
    return mixed(acc)


@dataclass
class Words:
    """Words of the documents ``first .. first + len(ptr) - 2``; ``ptr`` holds each document's first word."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    hashes: np.ndarray


def _not_space(part: np.ndarray) -> np.ndarray:
    return ~_SPACE[part]


def scan_words(
    column: pa.Array | pa.ChunkedArray,
    lower: bool = False,
    inside: Callable[[np.ndarray], np.ndarray] = _not_space,
    hashed: bool = True,
    at_once: int = SCAN_BYTES,
) -> Iterator[Words]:
    """The words of every document, in chunks of whole documents of about ``at_once`` bytes.

    ``inside`` says of each byte whether it lies in a word; without ``hashed`` the words carry no hashes.
    """
    data, off = text_bytes(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + at_once, side="right")) - 1)
        part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if lower:
            part = _LOWER[part]
        word = inside(part)
        before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = o[(o > 0) & (o < len(part))]
        before[inner] = False
        after[inner - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        hashes = word_hashes(part, starts, ends) if hashed else np.zeros(0, _U64)
        yield Words(lo, part, starts, ends, np.searchsorted(starts, o), hashes)
        lo = hi


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size`` of every pair, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(starts) or int(starts.max()) + total < 2**31) else np.int64
    out = np.repeat((starts - ends + sizes).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes between the borders as one Arrow column."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[spread(starts, sizes)])])
