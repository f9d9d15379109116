"""Vectorised hashing of words and shingles: numpy passes over the bytes of many texts, no loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_SLICE = 1 << 18
_P = U(0x9E3779B97F4A7C15 | 1)
_PI = U(pow(int(_P), -1, 1 << 64))

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _table(seed: int, fold: bool) -> np.ndarray:
    out = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    if fold:
        out[65:91] = out[97:123]
    return out


_FOLDED, _PLAIN = _table(11, True), _table(11, False)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i < n."""
    if "p" not in _powers or len(_powers["p"]) < n:
        n = 1 << max(18, (n - 1).bit_length())
        for k, base in (("p", _P), ("q", _PI)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII white space."""
    black = np.empty(len(buf) + 2, np.int8)
    black[0] = black[-1] = 0
    black[1:-1] = ~_WHITE[buf]
    edge = np.diff(black)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each run of bytes [start, end), by one running sum of table[byte] * P^i over each slice."""
    out = np.empty(len(starts), np.uint64)
    lut = _FOLDED if fold else _PLAIN
    k = 0
    while k < len(starts):
        lo = int(starts[k])
        m = max(k + 1, int(np.searchsorted(ends, lo + _SLICE, "right")))
        hi = int(ends[m - 1])
        p, q = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(lut[buf[lo:hi]] * p[: hi - lo], out=total[1:])
        s, e = starts[k:m] - lo, ends[k:m] - lo
        out[k:m] = mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64))
        k = m
    return out


def words_of(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the offset of each text's words (one more than texts)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = word_bounds(buf)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return run_hashes(buf, starts, ends, fold), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of width words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, U(width * 0xD6E8FEB86659FD93 % (1 << 64)))
    for k in range(width):
        out += words[k : k + n] * U(2 * k + 0xA0761D6478BD642F | 1)
        out = (out << U(7)) ^ (out >> U(57)) ^ out * U(0xE7037ED1A0B428DB)
    return mix(out)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence as one."""
    words, at = words_of(texts)
    every = shingle_hashes(words, width)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif n:
            out.append(shingle_hashes(words[a:b], n))
        else:
            out.append(words[:0])
    return out


def slices(lengths: list[int], most: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about most bytes together; a longer text is alone."""
    lo = size = 0
    for k, n in enumerate(lengths):
        if size and size + n > most:
            yield lo, k
            lo, size = k, 0
        size += n
    if lo < len(lengths):
        yield lo, len(lengths)
