"""64-bit hashes of words and runs of words, over whole slices of texts at once.

A word's hash is a polynomial of its bytes (running sums make every word's
value in one pass), its length mixed in, and finished with a full mixer. Runs
of words hash the same way over the words' hashes. Two different words or runs
agree with a chance of about 2^-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_RUN = 0xD6E8FEB86659FD93 | 1
_RUN_INV = pow(_RUN, -1, 1 << 64)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


_BLOCK = 1 << 14  # powers are held for so many places; the rest follows from the block's number


@lru_cache(maxsize=None)
def _within(base: int) -> np.ndarray:
    return _geometric(base, _BLOCK)


def _geometric(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1."""
    out = np.ones(max(1, n), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, 1 << 64))
        have += more
    return out[:n]


def _across(base: int, n: int) -> np.ndarray:
    """The powers at which the blocks of n places begin."""
    return _geometric(pow(base, _BLOCK, 1 << 64), -(-n // _BLOCK))


def powers(base: int, n: int) -> np.ndarray:
    return (_across(base, n)[:, None] * _within(base)).ravel()[:n]


def _sums(values: np.ndarray, base: int, look: np.ndarray | None = None) -> np.ndarray:
    """Running sums, from 0, of values times powers of the base, block by block; ``look`` gives the values of codes."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    for k, first in enumerate(_across(base, n).tolist()):
        lo, hi = k * _BLOCK, min(n, (k + 1) * _BLOCK)
        part = values[lo:hi] if look is None else look[values[lo:hi]]
        part = part * _within(base)[: hi - lo]
        part *= _U(first)
        part[:1] += sums[lo : lo + 1]
        np.cumsum(part, out=sums[lo + 1 : hi + 1])
    return sums


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, for each pair."""
    sums = _sums(data, _BASE, _BYTE)
    value = sums[end] - sums[start]
    value *= _across(_BASE_INV, len(data) + 1)[start // _BLOCK]
    value *= _within(_BASE_INV)[start % _BLOCK]
    return mix(value + (end - start).astype(np.uint64) * _U(_RUN))


def words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, data, start, end): the words' hashes; word index at which each text begins (and a last end); the joined bytes and where each word lies in them."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    white = _WHITE[data]
    turn = np.flatnonzero(white[1:] != white[:-1]) + 1
    start, end = turn[0::2], turn[1::2]
    hashes = spans(data, start, end)
    edges = 1 + np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return hashes, np.searchsorted(start, edges), data, start, end


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on (as many as fit into the array)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = _sums(mix(hashes), _RUN)
    return mix((sums[width:] - sums[:-width]) * powers(_RUN_INV, n)[: n - width + 1] + _U(width))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) of each ``width`` values in a row, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = pick(out[:-have], out[have:]), have * 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out
