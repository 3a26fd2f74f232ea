"""Elias-Fano coding of sequences that never fall, with select.

Each of ``m`` values below or at ``u`` is cut into ``floor(log2(u / m))`` low bits, which stand packed one
after the other, and a high part, which is counted in unary: value ``i`` sets bit ``high + i`` of one bit
string. Every ``SAMPLE``-th set bit's place is written down; ``select(i)`` starts from there
and looks at the bits up to the next sample. A value costs about two bits more than its low bits;
no offset is stored in full.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEAD = struct.Struct("<QQBI")  # values, first value, low bits, bytes of the high part


def _bits(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, lowest first, packed."""
    if not width or not len(values):
        return b""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits with a sign, none less than the one before it."""
    values = np.asarray(values, np.int64)
    m, first = len(values), int(values[0]) if len(values) else 0
    rest = values.view(np.uint64) - np.uint64(first & (1 << 64) - 1)
    width = max(0, (int(rest[-1]) // m).bit_length() - 1) if m else 0
    places = (rest >> np.uint64(width)).astype(np.int64) + np.arange(m)
    high = np.zeros(int(places[-1]) // 8 + 1 if m else 0, np.uint8)
    np.bitwise_or.at(high, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
    return HEAD.pack(m, first & (1 << 64) - 1, width, len(high)) + places[::SAMPLE].astype("<u4").tobytes() + high.tobytes() + _bits(rest, width)


class EliasFano:
    """A coded sequence, read from bytes; ``size`` is the number of bytes that it takes."""

    def __init__(self, data: bytes, at: int = 0):
        self.m, self.first, self.width, n_high = HEAD.unpack_from(data, at)
        at += HEAD.size
        n_samples = -(-self.m // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", n_samples, at).astype(np.int64)
        at += 4 * n_samples
        self.high = np.frombuffer(data, np.uint8, n_high, at)
        at += n_high
        n_low = (self.m * self.width + 7) // 8
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        self.size = HEAD.size + 4 * n_samples + n_high + n_low

    def __len__(self) -> int:
        return self.m

    def places(self, block: int) -> np.ndarray:
        """Places of the set bits that one sample stands before."""
        start = int(self.samples[block])
        end = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start >> 3 : (end + 7) >> 3], bitorder="little")
        found = np.flatnonzero(bits) + (start & ~7)
        return found[(found >= start) & (found < end)]

    def lows(self, a: int, b: int) -> np.ndarray:
        """Low bits of the values from ``a`` to ``b``."""
        if not self.width:
            return np.zeros(b - a, np.uint64)
        start, end = a * self.width, b * self.width
        bits = np.unpackbits(self.low[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start].reshape(-1, self.width)
        raw = np.zeros((b - a, 8), np.uint8)
        packed = np.packbits(bits, axis=1, bitorder="little")
        raw[:, : packed.shape[1]] = packed
        return raw.view("<u8").ravel()

    def block(self, block: int) -> np.ndarray:
        """The values from one sample to the next."""
        a, b = block * SAMPLE, min(self.m, (block + 1) * SAMPLE)
        high = (self.places(block) - np.arange(a, b)).astype(np.uint64)
        return ((high << np.uint64(self.width)) + self.lows(a, b) + np.uint64(self.first)).view(np.int64)

    def select(self, i) -> np.ndarray:
        """Values at some positions."""
        i = np.asarray(i, np.int64)
        out = np.zeros(len(i), np.int64)
        for b in np.unique(i // SAMPLE).tolist():
            at = np.flatnonzero(i // SAMPLE == b)
            out[at] = self.block(b)[i[at] - b * SAMPLE]
        return out

    def values(self) -> np.ndarray:
        blocks = [self.block(b) for b in range(len(self.samples))]
        return np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
