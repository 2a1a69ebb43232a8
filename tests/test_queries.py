"""Every query with SQL against DuckDB, and the invariants of those without."""

import numpy as np
import pytest
from compare import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = {n: q for f in entry.FAMILIES for n, q in f.queries.items()}
SQL = {n: s for f in entry.FAMILIES for n, s in f.sql.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, name):
    compare(spark, SF, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", ["e3_chunk_counts", "g3_grown_splits", "e10_moments", "f2_chunk_numbering", "e17_roll_fidelity"])
def test_partition_count_changes_nothing(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(repr, QUERIES[name](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_conditions_reach_the_end_of_clips(spark):
    """Frames after the tenth, and extremes that come later than the 40th sample."""
    sf = "/root/testdata/sf0.1"
    for name in ("k1_frame_condition", "k2_global_condition", "k4_add_condition"):
        compare(spark, sf, QUERIES[name], SQL[name])
    assert QUERIES["k1_frame_condition"](spark, sf).where("frame >= 10").count() > 0


@pytest.mark.parametrize("name", ["e10_moments", "j3_running_moments"])
def test_moments_of_whole_embeddings(spark, name):
    got = {(r["side"], r["i"], r["j"]): r["cov"] for r in QUERIES[name](spark, SF).collect()}
    assert len(got) == 2 * 64 * 64
    for side, v in embeddings_by_side(spark).items():
        cov = np.cov(np.array([x for _, x in v]), rowvar=False)
        assert np.allclose([[got[side, i, j] for j in range(64)] for i in range(64)], cov, atol=2e-6)


def embeddings_by_side(spark):
    out = {"real": [], "gen": []}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        out["real" if r["vec_id"] // 5 % 2 == 0 else "gen"].append((r["vec_id"] % 5, r["embedding"]))
    return out


def test_windowed_distances_of_whole_embeddings(spark):
    got = {r["window"]: r["fd"] for r in QUERIES["e25_windowed_distances"](spark, SF).collect()}
    sides = embeddings_by_side(spark)
    assert len(got) == 2
    for window, fd in got.items():
        frames = (0, 1) if window.startswith("1_") else (3, 4)
        a, b = (np.array([x for f, x in sides[k] if f in frames], float) for k in ("real", "gen"))
        ca, cb = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
        roots = np.sqrt(np.maximum(np.linalg.eigvals(ca @ cb).real, 0)).sum()
        assert fd == pytest.approx(((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca + cb) - 2 * roots, rel=1e-3)
