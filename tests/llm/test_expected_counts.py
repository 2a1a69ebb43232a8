"""Expected counts of pieces against all segmentations, and of long words against exact numbers."""

from fractions import Fraction

import numpy as np
import pytest

from chunkline.llm import langid


@pytest.fixture(scope="module")
def pieces():
    return langid.loaded(langid.default_vocab())


def piece_ids(pieces, word):
    """{(start, end): id} of the pieces in a marked word."""
    ids = pieces.ids(langid.places([word], len(word)))
    return {(i, i + k): int(x[0, i]) for k, x in enumerate(ids, 1) for i in range(x.shape[1]) if x[0, i] >= 0}


def by_force(pieces, word, prob):
    """Counts and sum over every way to cut the word, in exact numbers."""
    at, end = piece_ids(pieces, word), len(word) + 1
    starts = {}
    for (a, z), x in at.items():
        starts.setdefault(a, []).append((z, x))
    back = [Fraction(0)] * end + [Fraction(1)]
    for a in range(end - 1, -1, -1):
        back[a] = sum(Fraction(float(prob[x])) * back[z] for z, x in starts[a])
    ahead, counts = [Fraction(1)] + [Fraction(0)] * end, {}
    for a in range(end):
        for z, x in starts[a]:
            p = Fraction(float(prob[x]))
            ahead[z] += ahead[a] * p
            counts[x] = counts.get(x, 0) + ahead[a] * p * back[z]
    return {x: float(c / back[0]) for x, c in counts.items()}


def test_against_all_segmentations(pieces):
    rng = np.random.default_rng(2)
    prob = rng.dirichlet(np.full(pieces.n, 0.1)) + 1e-9
    words = ["a", "the", "nation", "straße", "你好", "zzz", "internationalisation" * 3, "".join(rng.choice(list("abcdefinorst"), 400))]
    weights = np.arange(1, len(words) + 1, dtype=float)
    want = np.zeros(pieces.n)
    for w, n in zip(words, weights, strict=True):
        for x, c in by_force(pieces, w, prob).items():
            want[x] += n * c
    got = langid.expected_counts(words, weights, pieces, prob)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_every_letter_of_a_long_word_is_counted(pieces):
    """A word far past the range of floats: its pieces cover all of its letters."""
    rng = np.random.default_rng(3)
    word = "".join(rng.choice(list("etaoinshrdlu"), 30_000))
    got = langid.expected_counts([word], np.ones(1), pieces, np.full(pieces.n, 1 / pieces.n))
    lengths = np.zeros(pieces.n)
    for (a, z), x in piece_ids(pieces, word).items():
        lengths[x] = z - a
    assert np.isfinite(got).all() and got @ lengths == pytest.approx(len(word) + 1, rel=1e-9)
