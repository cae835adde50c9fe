"""Array kernels over blocks of UTF-8 text.

Every kernel works on a :class:`Block`: the texts of some consecutive rows laid end to end in one
byte array with row offsets.  Blocks are bounded in bytes (a single longer text forms a block of its
own), so memory follows ``BLOCK_BYTES`` and the longest text, never the Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
#: Odd multipliers of the rolling and mixing hashes.
P_BYTE, P_WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)

#: True for the bytes of words: all but space and \t \n \v \f \r.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    first: int  # row of the batch where the block begins
    data: np.ndarray  # uint8
    offs: np.ndarray  # int64, rows + 1

    @property
    def rows(self) -> int:
        return len(self.offs) - 1


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a string array, null as the empty text, in blocks of about ``limit`` bytes."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offs_buf, data_buf = texts.buffers()
    offs = np.frombuffer(offs_buf, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield Block(row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row])
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> _S)
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        b = int(base)
        inverse = pow(b, -1, 1 << 64)
        self._base, self._inverse = np.uint64(b), np.uint64(inverse)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, base in (("up", self._base), ("down", self._inverse)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = {}


def powers(base: np.uint64) -> Powers:
    return _POWERS.setdefault(int(base), Powers(base))


class Prefix:
    """Hashes of any slice of a sequence in constant time: prefix sums of x[i] * p**i modulo 2**64.

    Modulo a power of two there are sequences, of 1,024 values and more, that collide whatever the base.
    So these hashes stand for content only in short slices, or where what they choose is compared later;
    ``digests`` and ``Checked`` stand for content of any length.
    """

    def __init__(self, values: np.ndarray, base: np.uint64 = P_BYTE):
        up, self.down = powers(base).upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * up[:-1] + up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of the slices; the length takes part."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * P_WORD)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of slices of one length: cheaper, and enough to test equality."""
        return (self.sums[end] - self.sums[start]) * self.down[start]


#: Slices above this many bytes are identified by a digest.
SHORT = 256
_PRIME, _BASE = (1 << 31) - 1, 1_103_515_277


def _reduced(x: np.ndarray) -> np.ndarray:
    """x below 2**62 modulo the Mersenne prime 2**31 - 1."""
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - np.uint64(_PRIME), x)


class Checked(Prefix):
    """Prefix with a second sum modulo a prime, for comparisons of slices of any length."""

    def __init__(self, values: np.ndarray, base: np.uint64 = P_WORD):
        super().__init__(values, base)
        n = len(values) + 1
        self._up, self._down = _prime_powers(1 << max(16, n.bit_length()))
        self._sums = np.zeros(n, np.uint64)
        np.cumsum(_reduced(_reduced(mix(values) >> np.uint64(2)) * self._up[: n - 1]), out=self._sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        second = _reduced(_reduced(self._sums[end] - self._sums[start]) * self._down[start])
        return mix(super().raw(start, end)) ^ (second * P_BYTE)


@cache
def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo the prime, by doubling."""
    out = []
    for base in (_BASE, pow(_BASE, -1, _PRIME)):
        powers_ = np.ones(1, np.uint64)
        while len(powers_) < n:
            powers_ = np.concatenate([powers_, _reduced(powers_ * np.uint64(pow(base, len(powers_), _PRIME)))])
        out.append(powers_)
    return out[0], out[1]


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 8) -> np.ndarray:
    """BLAKE2b of each slice, as rows of 64-bit numbers."""
    raw = memoryview(np.ascontiguousarray(data)).cast("B")
    wide = data.itemsize
    found = b"".join(hashlib.blake2b(raw[lo * wide : hi * wide], digest_size=size).digest() for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(found, np.uint64).reshape(-1, size // 8)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word that stands for it: long words by digest."""
    out = Prefix(data).of(starts, ends)
    long = np.flatnonzero(ends - starts > SHORT)
    if len(long):
        out[long] = digests(data, starts[long], ends[long])[:, 0]
    return out


def word_spans(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` and, by row, the index of its first word."""
    n = len(b.data)
    inside = WORD_BYTE[b.data]
    prev, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        prev[0], prev[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = b.offs[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        prev[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~prev)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, b.offs)


def row_of(offs: np.ndarray) -> np.ndarray:
    """Row of each element, given the rows' offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
