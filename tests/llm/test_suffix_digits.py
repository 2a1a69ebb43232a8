"""Strings whose first digits meet by design are told apart by their bytes."""

import hashlib

import numpy as np

from chunkline.llm import suffix_dedup
from test_operators import removed_by_force


def another_with_the_same_digit(sixteen: bytes, rng) -> bytes:
    """16 other printable bytes with the same hash of a digit."""
    c, shift = 0x9E3779B97F4A7C15, 29
    m = (1 << 64) - 1

    def first(w):
        h = w * c & m
        return h ^ h >> shift

    total = first(int.from_bytes(sixteen[:8], "little")) + int.from_bytes(sixteen[8:], "little")
    while True:
        head = bytes(rng.integers(33, 127, 8, dtype=np.uint8))
        tail = (total - first(int.from_bytes(head, "little")) & m).to_bytes(8, "little")
        if all(32 < b < 127 for b in tail) and head != sixteen[:8]:
            return head + tail


def test_unique_bytes_stay(spark):
    rng = np.random.default_rng(5)
    a = bytes(rng.integers(33, 127, 400, dtype=np.uint8))
    b = a[:101] + another_with_the_same_digit(a[101:117], rng) + a[117:]
    words = [suffix_dedup.digits(suffix_dedup.words_at(np.frombuffer(t, np.uint8))) for t in (a, b)]
    assert words[0][101] == words[1][101]
    d = spark.createDataFrame([(1, a.decode()), (2, b.decode())], "doc_id long, text string")
    got = [tuple(r) for r in suffix_dedup.dedup_strings(d, digests=True).collect()]
    assert sorted(got) == sorted(removed_by_force([(1, a), (2, b)]))
    assert got[-1][2] == 384 and dict((r[0], r[4]) for r in got)[2] == hashlib.sha256(b[101:117]).hexdigest()


def test_slice_digest_sees_every_byte():
    rng = np.random.default_rng(6)
    part = rng.integers(0, 256, 300, dtype=np.uint8)
    seeds = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, size = np.array([3]), np.array([67])

    def digest(buf):
        return tuple(int(h[0]) for h in suffix_dedup.slice_digest(suffix_dedup.words_at(buf), at, size, np.array([7]), seeds))

    seen = {digest(part)}
    for i in range(300):
        other = part.copy()
        other[i] ^= 1
        inside = 3 <= i < 70
        assert (digest(other) not in seen) == inside
        seen.add(digest(other))
    assert len(seen) == 68
