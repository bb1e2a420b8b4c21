"""Elias-Fano sequences over numpy arrays that may be memory-mapped.

A non-decreasing sequence is kept as packed low bits and a bit vector of high
parts in unary, with the count of ones and zeros before each 64-bit word. All
questions take arrays and answer arrays.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONE = _U(1)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits each, end to end in 64-bit words (and a spare word)."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * _U(bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        low = values << shift
        high = np.where(shift == 0, _U(0), values >> ((_U(64) - shift) & _U(63)))
        for add, where in ((low, word), (high, word + 1)):  # words come in order, so each word's parts are a run
            starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            out[where[starts]] |= np.bitwise_or.reduceat(add, starts)
    return out


def build(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of uint64."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> _U(bits)).astype(np.int64)
    ones = high + np.arange(n)
    words = (int(ones[-1]) + 1 if n else 0) // 64 + 2
    vector = np.zeros(words * 64, bool)
    vector[ones] = True
    packed = np.packbits(vector, bitorder="little").view("<u8")
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1]
    return {"meta": np.array([n, bits], np.int64), "low": _pack(values & _U((1 << bits) - 1), bits), "high": packed, "ones": before.astype(np.uint32), "zeros": (np.arange(words) * 64 - before).astype(np.uint32)}


_EACH = _U(0x0101010101010101)  # a one in every byte
_TOPS = _U(0x8080808080808080)
_M1, _M2, _M4 = _U(0x5555555555555555), _U(0x3333333333333333), _U(0x0F0F0F0F0F0F0F0F)
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).ravel()


def _nth_bit(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word: its byte by running counts, the bit in it by a table."""
    k = k.astype(np.uint64)
    upto = words - (words >> _ONE & _M1)
    upto = (upto & _M2) + (upto >> _U(2) & _M2)
    upto = (upto + (upto >> _U(4)) & _M4) * _EACH  # ones in the bytes up to each
    byte = np.bitwise_count(((k * _EACH | _TOPS) - upto) & _TOPS).astype(np.uint64) << _U(3)
    k = k - (upto << _U(8) >> byte & _U(255))
    return (byte + _IN_BYTE[(words >> byte & _U(255)) << _U(3) | k]).astype(np.int64)


def _gap(words: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros between each word's bit and its next set one, whether there is one)."""
    rest = words >> bit.astype(np.uint64) >> _ONE
    return np.bitwise_count(~rest & (rest - _ONE)).astype(np.int64), rest != 0


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["meta"])
        self.low, self.high, self.ones, self.zeros = (arrays[k] for k in ("low", "high", "ones", "zeros"))
        self.mask = _U((1 << self.bits) - 1)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        upper = np.where(shift == 0, _U(0), self.low[word + 1] << ((_U(64) - shift) & _U(63)))
        return (self.low[word] >> shift | upper) & self.mask

    def _one(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, its bits, bit) of the i-th ones."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), "right") - 1
        bits = self.high[word]
        return word, bits, _nth_bit(bits, i - self.ones[word].astype(np.int64))

    def _zero(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, its bits turned over, bit) of the k-th zeros."""
        word = np.searchsorted(self.zeros, k.astype(np.uint32), "right") - 1
        bits = ~self.high[word]
        return word, bits, _nth_bit(bits, k - self.zeros[word].astype(np.int64))

    def _value(self, place: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (place - i).astype(np.uint64) << _U(self.bits) | self._lows(i)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word, _, bit = self._one(i)
        return self._value(word * 64 + bit, i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i and i + 1; the second is mostly in the first's word."""
        word, bits, bit = self._one(i)
        place = word * 64 + bit
        gap, inside = _gap(bits, bit)
        after = place + 1 + gap
        far = np.flatnonzero(~inside)
        if len(far):
            word, _, bit = self._one(i[far] + 1)
            after[far] = word * 64 + bit
        return self._value(place, i), self._value(after, i + 1)

    def _after_zeros(self, k: np.ndarray) -> np.ndarray:
        """Values before the k-th (from 0) zero of the high parts; all of them beyond the last."""
        total = len(self.high) * 64 - self.n
        inside = np.minimum(k, total - 1)
        word, _, bit = self._zero(inside)
        return np.where(k >= total, self.n, word * 64 + bit - inside)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values with these high parts: between two zeros, mostly of one word."""
        total = len(self.high) * 64 - self.n
        k = np.clip(high - 1, 0, total - 1)
        word, bits, bit = self._zero(k)
        run, inside = _gap(bits, bit)
        at = np.where(high > 0, word * 64 + bit - k, 0)
        at = np.where(high > total, self.n, at)
        end = at + run
        far = np.flatnonzero(~inside | (high <= 0) | (high >= total))
        end[far] = self._after_zeros(high[far])
        return at, end

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value (the first, if repeated), or -1."""
        if not self.n:
            return np.full(len(values), -1)
        at, end = self._bucket((values >> _U(self.bits)).astype(np.int64))
        want, last = values & self.mask, end
        while len(open_ := np.flatnonzero(at < end)):
            mid = (at[open_] + end[open_]) >> 1
            less = self._lows(mid) < want[open_]
            at[open_] = np.where(less, mid + 1, at[open_])
            end = end if end is not last else end.copy()
            end[open_] = np.where(less, end[open_], mid)
        hit = at < last
        hit[hit] = self._lows(at[hit]) == want[hit]
        return np.where(hit, at, -1)
