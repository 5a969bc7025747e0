"""Word and window hashes of whole Arrow string columns, as numpy kernels.

Words are runs of bytes other than ASCII white space, found in the column's own
buffer without making Python strings. All sums are modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 2 << 20
#: Bytes hashed at once, unless a word is longer: the sums and powers take 8 bytes for each.
BLOCK_BYTES = (1 << 18) - 1
_BASES = (0x9E3779B97F4A7C15 & ~7 | 5, 0xC2B2AE3D27D4EB4F & ~7 | 5)  # 5 modulo 8: powers repeat late
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For words without punctuation: every ASCII byte that is not a letter or digit parts them.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each input bit over all output bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_codes() -> tuple[np.ndarray, np.ndarray]:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    lower = codes.copy()
    lower[65:91] = codes[97:123]
    return codes, lower


_CODES, _LOWER_CODES = _byte_codes()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least ``n`` of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = out[0], out[1]
        if size <= 1 << 22:
            _POWERS[which] = have
    return have


@dataclass
class Words:
    """Words of the texts ``rows`` of a column; word positions are byte offsets."""

    rows: range
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of each text the index of its first word; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(column: pa.Array, lower: bool = False, breaks: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of a string column, a few texts at a time. Null texts have none."""
    if not len(column):
        return
    column = column.cast(pa.string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield _words(data, offsets[at : stop + 1], range(at, stop), lower, breaks)
        at = stop


def _words(data: np.ndarray, offsets: np.ndarray, rows: range, lower: bool, breaks: np.ndarray) -> Words:
    low, high = int(offsets[0]), int(offsets[-1])
    space = breaks[data[low:high]]
    edge = np.zeros(high - low + 1, dtype=bool)
    edge[offsets - low] = True
    solid = ~space
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= space[:-1] | edge[1:-1]
    stops[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    codes = _LOWER_CODES if lower else _CODES
    hashes = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):  # words by blocks of bytes, so that a long text needs no long arrays
        upto = max(k + 1, int(np.searchsorted(ends, starts[k] + BLOCK_BYTES, side="right")))
        a, b = int(starts[k]), int(ends[upto - 1])
        power, inverse = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(codes[data[low + a : low + b]] * power[: b - a], out=sums[1:])
        s, e = starts[k:upto] - a, ends[k:upto] - a
        hashes[k:upto] = (sums[e] - sums[s]) * inverse[s]
        k = upto
    first = np.searchsorted(starts, offsets - low)
    return Words(rows, data, starts + low, ends + low, mix(hashes), first)


def window_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` words, by its first word; empty if there are fewer."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(hashes) + 1, which)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * inverse[:n] + np.uint64(length))

