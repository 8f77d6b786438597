"""Word shingles of whole texts as 64-bit hashes, a batch of texts at a time in numpy.

Words are runs of bytes other than blanks (0x20 and 0x09 to 0x0D), A-Z lower-cased. A word's hash is a polynomial of its bytes, taken from prefix sums; a
shingle's hash mixes the hashes of its words in order. Arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_COUNT = 0xEB44ACCAB455D165

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection that spreads bits (the finaliser of splitmix64)."""
    x = x + _U((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _counted(n: np.ndarray | int) -> np.ndarray:
    """Counts of bytes or words as a term of a hash."""
    return np.atleast_1d(np.asarray(n, np.uint64)) * _U(_COUNT)


def _power(name: str, n: int) -> np.ndarray:
    have = _powers[name]
    base = _BASE if name == "up" else _INVERSE
    while len(have) < n:
        have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
    # Of a single long text no more is kept than texts usually need.
    if len(have) > len(_powers[name]):
        _powers[name] = have[: min(n + 65536, 1 << 21)].copy()
    return have[:n]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a text's bytes."""
    blank = _blank[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_lower[data].astype(np.uint64) * _power("up", len(data)), out=sums[1:])
    return start, mix((sums[end] - sums[start]) * _power("down", len(data))[start] + _counted(end - start))


def shingles(texts: list[bytes | None], size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the whole sequence is the only shingle of a text with fewer words; none without words."""
    lengths = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    start, word = words(data)
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    full = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        full += word[k : k + len(full)] * _PLACES[k]
    full = mix(full + _counted(size))
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            whole = (word[a:b] * np.array(_PLACES[: b - a], np.uint64)).sum(dtype=np.uint64)
            out.append(mix(whole + _counted(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
