"""Vectorised word and shingle hashes over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE, _POWERS = 0x9E3779B97F4A7C15 | 1, {}
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

#: Powers are computed for texts of this many bytes at least.
SHORTEST = 5 << 18

#: ASCII white space: blank and 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes that are neither letters nor digits; bytes of other characters belong to words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z become a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seed(k: int) -> np.uint64:
    return mix(np.array([k + 1], dtype=np.uint64) * U(_BASE))[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, SHORTEST)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(n, U(base))
                x[0] = 1
                _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def words(texts: list[bytes], separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, with the index of each word's text and its byte range.

    Returns (hash, text index, start, end, buffer); starts and ends point into the buffer, the lower-cased texts put
    one after the other with a separator between them.
    """
    joined = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    if not len(joined):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, joined
    low = LOWER[joined]
    inside = np.zeros(len(low) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[low]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[low] * up[: len(low)], out=sums[1:])
    hashed = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return hashed, owner, starts, ends, low


def prefixes(low: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes from each start."""
    up, _ = _powers(length)
    out = np.zeros(len(starts), dtype=np.uint64)
    for j in range(length):
        out += _BYTES[low[starts + j]] * up[j]
    return mix(out + U(length))


def shingles(hashed: np.ndarray, owner: np.ndarray, n_texts: int, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; a text of fewer words than ``width`` has its whole sequence
    as one, a text without words none."""
    bounds = np.searchsorted(owner, np.arange(n_texts + 1))
    rolled = np.zeros(max(0, len(hashed) - width + 1), dtype=np.uint64)
    for j in range(width):
        rolled += hashed[j : len(hashed) - width + 1 + j] * (seed(1000 + j) | U(1))
    rolled = mix(rolled)
    out = []
    for k in range(n_texts):
        a, b = bounds[k], bounds[k + 1]
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            factors = np.array([seed(1000 + j) | U(1) for j in range(b - a)])
            out.append(mix((hashed[a:b] * factors).sum(keepdims=True) + seed(2000 + int(b - a))))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
