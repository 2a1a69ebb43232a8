"""Hashes of the words of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 21
_rng = np.random.default_rng(20240607)
LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes between words: ASCII white space, and for plain words ASCII punctuation too.
SPACES = np.zeros(256, bool)
SPACES[[*range(9, 14), *range(28, 33)]] = True
MARKS = SPACES.copy()
MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in their order."""
    h = np.zeros_like(parts[0])
    for x in parts:
        h = mix(h * np.uint64(3) + x)
    return h


def words_hashed(texts: list[str | None], between: np.ndarray = MARKS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word and the number of its text, in order."""
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    buf = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    gap = between[buf]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):  # in segments that end at a word's end, for bounded memory
        z = max(a + 1, int(np.searchsorted(end, start[a] + SEGMENT, "right")))
        lo, hi = start[a], end[z - 1]
        up, down = powers(hi - lo + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[buf[lo:hi]] * up[: hi - lo])])
        out[a:z] = (sums[end[a:z] - lo] - sums[start[a:z] - lo]) * down[start[a:z] - lo]
        a = z
    return mix(out), np.searchsorted(begin, start, "right") - 1


def word_hash(word: str) -> int:
    return int(words_hashed([word])[0][0])
