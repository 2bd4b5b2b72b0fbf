"""Vectorised 64-bit hashes of words and runs of bytes."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
#: A random value for each byte, with A-Z as themselves or as a-z.
EXACT = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: The ASCII white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(name: str, n: int) -> np.ndarray:
    """The first n powers of BASE or INVERSE, modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = BASE if name == "base" else INVERSE
        have = np.full(max(n, 1 << 16), base)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefixes(data: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """Running sums of table[byte] * BASE**place, with a leading 0."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers("base", len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of data[start:end], wherever it stands, from prefixes(data)."""
    return mix((sums[end] - sums[start]) * powers("inverse", len(sums))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, hash of each word in lower case)."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    return start, spans(prefixes(data, LOWER), start, end)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of runs of n words, sorted; the whole sequence as one where there are fewer words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    m = len(hashes) - n + 1
    out = np.full(m, np.uint64(n))
    for k in range(n):
        out = mix(out * BASE + hashes[k : k + m])
    return np.unique(out)
