"""Near pairs of fingerprints and neighbours in id order, against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest

from chunkline.llm import spotsigs
from chunkline.llm.common import table
from llm_edge import SF, docs, no_docs

NO_ID = spotsigs.NO_ID


def set_of(text):
    keys = spotsigs.signature_keys([text or ""], spotsigs.anchors())
    return frozenset(keys.tolist())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def classes_by_force(texts, similarity=0.8):
    """Least id of each class of {id: text}: union of all pairs with the likeness."""
    sets, root = {i: set_of(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in texts if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and jaccard(a, b) >= similarity - 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in texts}


def classes(df, **options):
    return {r["key"]: r["class_key"] for r in spotsigs.near_classes(df, **options).collect()}


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_classes_of_the_table(spark, similarity):
    d = table(spark, SF, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    want = classes_by_force(texts, similarity)
    assert classes(d, similarity=similarity) == want and len(set(want.values())) < len(want)


def test_families_at_the_threshold(spark):
    """Families around one text, with likenesses on both sides of the threshold, of all lengths; common signatures everywhere."""
    rng, texts = random.Random(7), []
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lt", "rn", "sk", "mp")]
    for f in range(12):
        first = [w for _ in range(rng.choice((2, 4, 9, 40, 150))) for w in ("the", *rng.sample(words, 2), f"own{f}")]
        for _ in range(18):
            t = list(first)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t) + " of common passage that everyone repeats in the same words" * rng.choice((0, 1)))
    rng.shuffle(texts)
    rows = dict(enumerate(texts))
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    want = classes_by_force(rows)
    assert 12 < len(set(want.values())) < len(texts)
    assert classes(d) == want


def test_classes_odd(spark):
    d, got = docs(spark), classes(docs(spark))
    texts = {NO_ID if r["doc_id"] is None else r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    assert got == classes_by_force(texts)
    assert got[5] == 4 and got[6] == NO_ID and got[1] == 1 and got[9] == 9
    assert spotsigs.near_classes(no_docs(spark)).count() == 0


def test_parts_of_lengths(spark):
    """Lengths that can be alike lie in one part or in neighbouring ones, at exact ratios too."""
    d = spark.range(1, 4000).select("id", spotsigs.length_part(spotsigs.F.col("id"), 0.8).alias("part")).orderBy("id").toPandas()
    part = dict(zip(d.id, d.part, strict=True))
    assert all(part[-(-4 * n // 5)] >= part[n] - 1 for n in range(1, 4000))


def test_ranges_hold_their_cuts():
    rng = np.random.default_rng(1)
    rows = sorted({(int(k), int(h)) for k, h in zip(rng.integers(0, 9, 400), rng.integers(-9, 9, 400), strict=True)} | {(2**62 + k, 0) for k in range(9)})
    cuts = [rows[0], *sorted(rng.choice(len(rows), 25, False).tolist())]
    cuts = sorted({rows[0]} | {rows[c] for c in cuts[1:]})
    to, first = spotsigs.range_of((np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])), np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert to.tolist() == [sum(c <= r for c in cuts) - 1 for r in rows] and first.tolist() == [r in cuts for r in rows]


@pytest.mark.parametrize("per_range", [1, 2, 1000])
def test_neighbours_in_id_order(spark, per_range):
    """Ids above 2**53, repeated ids and rows, a null id: every row meets the next, in ranges of any size."""
    rng = random.Random(5)
    ids = [None, 2**60, 2**60 + 1, 2**60 + 2, -5, *range(12), 7, 7, 7]
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choice(["the", *words]) for _ in range(rng.randint(0, 60)))) for i in ids]
    rows += [rows[5], rows[5]]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = d.select("doc_id", "text", spotsigs.F.xxhash64("text").alias("h")).collect()
    order = sorted(order, key=lambda r: (NO_ID if r["doc_id"] is None else r["doc_id"], r["h"]))
    want = []
    for k, r in enumerate(order):
        t, u = r["text"], order[(k + 1) % len(order)]["text"]
        e = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        want.append((r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest(), jaccard(set_of(t), set_of(e)), jaccard(set_of(t), set_of(u))))
    got = spotsigs.compare_edited(d, rows_per_range=per_range).collect()
    named = lambda r: (r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"])
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(map(named, got), key=key) == sorted(want, key=key)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["class_id"])
        assert len(base64.b64decode(r["fingerprint"])) % 4 == 0
    # one class for each id
    assert all(len(c) == 1 for c in of.values()) and of[2**60 + 1] == {2**60 + 1}


def test_a_large_group_is_few_pairs(spark, monkeypatch):
    """Many copies of one text, each with a change of its own, become one class without a pair for each two of them."""
    rng, seen = random.Random(3), []
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lt", "rn", "sk", "mp")]
    first = [w for k in range(60) for w in ("the", rng.choice(words), f"own{k}")]
    texts = {0: " ".join(first)}
    for i in range(1, 150):
        t = list(first)
        t[3 * rng.randrange(60) + 2] = f"new{i}"
        texts[i] = " ".join(t)
    kept = spotsigs.verified
    monkeypatch.setattr(spotsigs, "verified", lambda pairs, *rest: (seen.append(pairs.count()), kept(pairs, *rest))[1])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert set(classes(d).values()) == {0} and sum(seen) < 2 * len(texts)


def test_tally_grows_with_the_signatures():
    """Cells of the tally hold about as many signatures whatever their number, so rare ones are told from common ones."""
    for n in (10**7, 10**8, 10**9):
        assert spotsigs.LOAD / 2 <= n / spotsigs.cells_for(n) <= spotsigs.LOAD
    assert spotsigs.cells_for(0) == spotsigs.SEGMENT and spotsigs.cells_for(10**12) == spotsigs.MOST_CELLS
