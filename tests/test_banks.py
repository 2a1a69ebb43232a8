"""Neighbours of bank items against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkline.operators import banks as B


def bank_of(spark, rows):
    return spark.createDataFrame([(c, f"f{i:05d}", v.tolist()) for i, (c, v) in enumerate(rows)], "class_name int, file_name string, embedding array<double>")


def clustered(rng, n, d=8, centres=12):
    c = rng.normal(size=(centres, d))
    return [(i % 2, c[rng.integers(centres)] + rng.normal(scale=0.05, size=d)) for i in range(n)]


def by_force(rows):
    """(class, pos) -> cosines with the other positions."""
    out = {}
    for k in {c for c, _ in rows}:
        v = np.array([x for c, x in rows if c == k])
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        cos = u @ u.T
        np.fill_diagonal(cos, -np.inf)
        out |= {(k, i): cos[i] for i in range(len(v))}
    return out


@pytest.mark.parametrize("size, ring", [(1024, 0.1), (16, 0.05), (5, 1.0)])
def test_nearest_is_exact(spark, size, ring):
    rows = clustered(np.random.default_rng(1), 300)
    items, _ = B.distinct_items(bank_of(spark, rows))
    got = {(r["class_name"], r["pos"]): r for r in B.nearest_items(items, ring=ring, size=size).collect()}
    want = by_force(rows)
    assert got.keys() == want.keys()
    for k, cos in want.items():
        assert got[k]["cos"] == pytest.approx(cos.max(), abs=1e-12) and got[k]["other"] == int(cos.argmax())


def test_pivots_close_pairs_of_tiles(spark):
    """Well parted clusters: few pairs of tiles are left, and none of the plan's joins makes pairs of items."""
    rows = clustered(np.random.default_rng(2), 600, d=3, centres=30)
    items, _ = B.distinct_items(bank_of(spark, rows))
    tiled = B.staged(B.tiles(items, size=16), "tiles")
    own = B.staged(B.nearest_within(tiled, "class_name", "tile"), "own")
    n = {r["class_name"]: r["n"] for r in tiled.groupBy("class_name").agg(F.countDistinct("tile").alias("n")).collect()}
    assert B.open_pairs(tiled, own).count() < 0.3 * sum(k * (k - 1) // 2 for k in n.values())


def test_random_projections_find_most(spark):
    rows = clustered(np.random.default_rng(3), 400)
    items, _ = B.distinct_items(bank_of(spark, rows))
    got = {(r["class_name"], r["pos"]): r["cos"] for r in B.nearest_items_roughly(items).collect()}
    want = by_force(rows)
    assert np.mean([abs(got.get(k, -2) - cos.max()) < 1e-9 for k, cos in want.items()]) >= 0.9
    assert all(v <= want[k].max() + 1e-9 for k, v in got.items())


def test_spread_of_odd_banks(spark):
    """Repeats, zero vectors, a bank of one, a bank of equal items."""
    e = np.eye(3)
    rows = [(0, e[0]), (0, e[0]), (0, e[0] + e[1]), (0, 0 * e[0]), (1, e[1]), (2, e[2]), (2, e[2])]
    spread, nearest, repeats = B.bank_spread(bank_of(spark, rows))
    (r,) = spread.collect()
    assert (r["class_name"], r["pairs"], r["close"]) == (0, 3, False)
    assert r["mean"] == pytest.approx(2**-0.5) and r["largest"] == pytest.approx(2**-0.5)
    assert sorted((x["pos"], x["other"]) for x in nearest.collect()) == [(0, 2), (2, 0)]
    assert sorted(tuple(x) for x in repeats.collect()) == [(0, 1, 0), (2, 1, 0)]
    spread, nearest, repeats = B.bank_spread(bank_of(spark, rows).limit(0))
    assert spread.count() == nearest.count() == repeats.count() == 0
