"""Hand-computed micro-tables."""

import math

import beats_by_force as by_force
import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkline.functions import series as A
from chunkline.functions import text as T
from chunkline.operators import beats as B
from chunkline.operators import chunks as C
from chunkline.operators import conditions as K
from chunkline.operators import frames as R
from chunkline.operators import notes as N
from chunkline.operators import report as P
from chunkline.operators import scores as S
from chunkline.operators import splits as G
from chunkline.operators import stats as M
from chunkline.sources import catalog, sidecar, storage


def test_allocation(spark):
    want = {0: (0, 0, 0), 1: (1, 0, 0), 2: (1, 0, 1), 3: (1, 1, 1), 5: (3, 1, 1), 10: (8, 1, 1), 15: (11, 2, 2), 25: (21, 2, 2)}
    d = spark.createDataFrame([(n,) for n in want], "n long").select("n", *[c.alias(k) for k, c in G.allocate_three(F.col("n"), (0.8, 0.1, 0.1)).items()])
    assert {r["n"]: (r["train"], r["val"], r["test"]) for r in d.collect()} == want


@pytest.mark.parametrize("bad", [(0.5, 0.5), (0.9, 0.2, -0.1), (0.5, 0.2, 0.2)])
def test_ratios(bad):
    with pytest.raises(ValueError):
        G.check_ratios(bad)


def test_names(spark):
    d = spark.createDataFrame([("a/b/Été x--y!.Wav",), (".hidden",), ("",)], "p string")
    got = d.select(T.sanitize_file(F.col("p")), T.sanitize_class(F.col("p")), T.path_key(F.col("p"))).collect()
    assert got[0][0] == "t_x_y" and got[1][0] == "hidden" and got[2][0] == "unknown" == got[2][1]
    assert got[0][2] == "a/b/été x--y!.wav"
    name = d.limit(1).select(T.chunk_name(F.col("p"), F.lit(12345)).alias("c"), T.group_key(F.col("p")).alias("g"))
    r = name.select("c", "g", T.chunk_group(F.col("c")).alias("back")).first()
    assert r["c"].endswith("__c12345") and r["g"] == r["back"]


def test_splits_never_move(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("group_key"), (F.col("id") % 3).cast("string").alias("bucket"))
    first = G.assign_splits(keys.where("group_key < 'k3'"))
    was = {r["group_key"]: r["split"] for r in first.collect()}
    now = {r["group_key"]: r["split"] for r in G.assign_splits(keys, existing=first).collect()}
    assert len(now) == 500 and all(now[k] == v for k, v in was.items())
    counts = {r["split"]: r["n"] for r in G.split_counts(spark.createDataFrame(list(now.items()), "group_key string, split string")).collect()}
    assert counts["val"] == pytest.approx(50, abs=3) and counts["test"] == pytest.approx(50, abs=3)


def test_unassigned_chunks_stop(spark):
    with pytest.raises(ValueError, match="1 chunks"):
        G.require_assigned(spark.createDataFrame([("a__c0001", None)], "rel_chunk string, split string"))
    with pytest.raises(ValueError, match="differ"):
        G.require_same_params({"seed": "1"}, {"seed": "2"})


def test_gate_asymmetry(spark):
    s = spark.createDataFrame([(1, i, 1.0 if i < 5 else 0.0) for i in range(10)], "k long, seq int, x double")
    assert C.source_gates(s, "k", peak=0.5, max_peak_ratio=0.5).count() == 1
    assert C.source_gates(s, "k", silence=0.5, max_silence_ratio=0.5).count() == 0


def test_numbering(spark):
    levels = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 10, 0.0, 0.0), (1, 20, 1.0, 0.0), (1, 30, 1.0, -80.0), (1, 40, 1.0, 0.0)], "k long, start long, rms double, dbfs double").withColumn("peak", F.col("rms"))
    got = C.numbered_chunks(levels, "k", rms=0.5, min_dbfs=-60.0)
    assert sorted((r["start"], r["idx"]) for r in got.collect()) == [(0, 0), (20, 1), (40, 3)]


def test_pairing(spark):
    m = [(1, t, k) for t, k in ((1, "on"), (2, "off"), (3, "off"), (4, "on"), (5, "on"), (6, "off"), (9, "other"))]
    d = spark.createDataFrame(m, "clip long, t long, kind string").withColumn("note", F.lit(60))
    got = N.pair_on_off(d.where("kind <> 'other'").unionByName(d.where("kind = 'other'").withColumn("note", F.lit(1)).withColumn("kind", F.lit("off"))), ["clip"], ["t"], "t")
    assert sorted((r["start"], r["stop"]) for r in got.where("note = 60").collect()) == [(1, 2), (4, 6), (5, 9)]


def test_drum_before_window(spark):
    d = spark.createDataFrame([(1, -0.01, 0.2, 36, True), (1, 0.0, 0.2, 36, True)], "clip long, onset double, offset double, pitch int, is_drum boolean")
    assert [(r["frame"], r["slot"]) for r in N.notes_to_cells(d, ["clip"], 50.0, 100).collect()] == [(0, 176)]


def test_notes_round_trip(spark):
    d = spark.createDataFrame([(1, 0.1, 0.5, 60, False), (1, 0.5, 0.9, 60, False), (1, 0.2, 0.3, 72, False)], "clip long, onset double, offset double, pitch int, is_drum boolean")
    back = N.cells_to_notes(N.notes_to_cells(d, ["clip"], 50.0, 100), ["clip"])
    assert sorted((r["pitch"], r["start"], r["stop"]) for r in back.collect()) == [(60, 5, 25), (60, 25, 45), (72, 10, 15)]


def test_peaks_merge(spark):
    rows = [(1, f, 0.9 if f in (10, 11, 12) else 0.0) for f in range(30)]
    got = R.peak_times(spark.createDataFrame(rows, "k long, f int, v double"), "k", "f", "v", 1.0).first()["times"]
    assert got == [10.5, 12.0]


def test_greedy_matching():
    assert by_force.greedy_matches([1.00, 1.06], [1.04, 1.10], 0.05) == 2
    assert by_force.greedy_matches([], [1.0], 0.05) == 0


def test_empty_transcriptions(spark):
    d = spark.createDataFrame([("both", 0, 0, 0), ("no_est", 2, 0, 0), ("no_ref", 0, 2, 0)], "k string, n_ref long, n_est long, n_match long")
    got = {r["k"]: tuple(r)[1:] for r in S.match_scores(d, ["k"]).collect()}
    nan = lambda t: tuple("nan" if math.isnan(x) else x for x in t)
    assert nan(got["both"]) == ("nan",) * 3 and nan(got["no_est"]) == ("nan", 0, 0) and nan(got["no_ref"]) == (0, "nan", "nan")


def test_flat_curve_is_nan(spark):
    d = spark.createDataFrame([(1, 1.0, float(i)) for i in range(5)], "k long, t double, g double")
    assert math.isnan(S.pearson_fidelity(d, ["k"], "t", "g").first()["score"])


def test_beats():
    ref = np.arange(1, 11, dtype=float)
    assert by_force.beat_measures(ref, ref) == pytest.approx((1, 1, 1, 1, 1))
    half = by_force.beat_measures(ref, np.arange(1, 10.5, 0.5))
    assert half[3] < 0.5 and half[4] == pytest.approx(1)
    assert all(map(math.isnan, by_force.beat_measures(np.zeros(0), ref)))


def test_beat_values():
    """Offsets of known size: Cemgil is exp(-offset^2 / (2 * 0.04^2)), phases within 0.175 periods keep continuity."""
    ref = np.arange(1, 11, dtype=float)
    f, cemgil, p, cmlt, amlt = by_force.beat_measures(ref, ref + 0.04)
    assert (f, cemgil, p, cmlt, amlt) == pytest.approx((1, math.exp(-0.5), 1, 1, 1))
    f, cemgil, p, cmlt, amlt = by_force.beat_measures(ref, ref + 0.25)
    assert f == 0 and cemgil == pytest.approx(math.exp(-(0.25**2) / (2 * 0.04**2))) and p == 0 and cmlt == 0
    f, _, p, cmlt, _ = by_force.beat_measures(ref, ref[:5])
    assert f == pytest.approx(2 * 5 / 15) and p == pytest.approx(0.5) and cmlt == pytest.approx(0.5)
    # on the off-beats: all but the last, which has no off-beat near it
    assert by_force.beat_measures(ref, ref + 0.5)[3:] == pytest.approx((0, 0.9))


def test_greedy_matching_is_maximal():
    """On sorted lists the greedy matches are as many as a maximum matching has."""
    rng = np.random.default_rng(8)

    def most(a, b):
        owner = {}

        def seat(i, seen):
            for j in range(len(b)):
                if abs(a[i] - b[j]) <= 0.05 + 1e-12 and j not in seen:
                    seen.add(j)
                    if j not in owner or seat(owner[j], seen):
                        owner[j] = i
                        return True
            return False

        return sum(seat(i, set()) for i in range(len(a)))

    for _ in range(200):
        a, b = (np.sort(rng.integers(0, 100, rng.integers(0, 12)) / 50).tolist() for _ in "ab")
        assert by_force.greedy_matches(a, b, 0.05) == most(a, b)


def test_transcription_values(spark):
    d = spark.createDataFrame([("k", 4, 5, 3)], "k string, n_ref long, n_est long, n_match long")
    assert tuple(S.match_scores(d, ["k"]).first())[1:] == pytest.approx((3 / 5, 3 / 4, 6 / 9))


def test_distances_in_closed_form():
    """Of Gaussians with diagonal covariances."""
    r = np.random.default_rng(1)
    (m1, m2), (a, b) = r.normal(size=(2, 8)), r.uniform(0.5, 2, size=(2, 8))
    e = 1e-6
    fd = ((m1 - m2) ** 2).sum() + ((np.sqrt(a + e) - np.sqrt(b + e)) ** 2).sum()
    kl = 0.5 * ((a + e) / (b + e) + (m1 - m2) ** 2 / (b + e) - 1 + np.log((b + e) / (a + e))).sum()
    assert M.frechet(m1, np.diag(a), m2, np.diag(b)) == pytest.approx(fd, rel=1e-6)
    assert M.gaussian_kl(m1, np.diag(a), m2, np.diag(b)) == pytest.approx(kl, rel=1e-6)


def test_subsets(spark):
    got = {r["label"]: r["members"] for r in P.condition_subsets(spark, ["ALL", "leave_one_out", ["c", "a"], "each", [], ["b"]], ["a", "b", "c", "d"]).collect()}
    assert got["no_d"] == ["a", "b", "c"] and got["a+c"] == ["a", "c"] and got["only_b"] == ["b"] and got["all"] == ["a", "b", "c", "d"] and len(got) == 10


def test_white_space_of_all_kinds(spark):
    from chunkline.functions import text as X

    d = spark.createDataFrame([("\u3000 a\u00a0\u2003b\x1f\tc\n", "\u00a0./Dir/É.wav \u2009")], "t string, p string")
    r = d.select(X.clean_text(F.col("t")).alias("t"), X.path_key(F.col("p")).alias("p")).first()
    assert tuple(r) == ("a b c", "dir/é.wav")


def gaussians(d=32):
    r = np.random.default_rng(0)
    out = []
    for _ in range(2):
        a = r.normal(size=(d, d))
        out.append((r.normal(size=d), a @ a.T / d))
    return out


def test_distances():
    a, b = gaussians()
    assert M.gaussian_kl(*a, *a) < 1e-5 and abs(M.frechet(*a, *a)) < 1e-3
    assert M.frechet(*a, *b) > 0 and M.gaussian_kl(*a, *b) > 0 and M.gaussian_kl(*a, *b) != pytest.approx(M.gaussian_kl(*b, *a))


def test_moments_do_not_depend_on_parts(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("k"), F.array(*[F.rand(i) for i in range(6)]).alias("v")).repartition(3)
    x = {r["k"]: r for r in M.moments(rows, "k", "v").collect()}
    y = {r["k"]: r for r in M.moments(rows.repartition(11), "k", "v").collect()}
    for k in x:
        assert x[k]["n"] == y[k]["n"] and np.allclose(x[k]["sxx"], y[k]["sxx"], rtol=1e-12)


def test_stats_guard(spark):
    with pytest.raises(ValueError):
        M.require_sound_stats(spark.createDataFrame([(0, 1.0, 0.0)], "d int, mean double, std double"))


def test_registry(spark):
    reg = K.Registry().add(K.Condition("a", 1, lambda x: [v[:, None] for v in x]))
    with pytest.raises(ValueError, match="unknown"):
        reg.enabled(["b"])
    chunks = spark.createDataFrame([("c1", [1.0, 2.0]), ("c2", [3.0, float("nan")])], "rel_chunk string, x array<double>")
    got = K.add_conditions(chunks.where("rel_chunk = 'c1'"), spark.createDataFrame([], K.LONG), reg.enabled(["a"])).collect()
    assert sorted((r["frame"], r["v"][0]) for r in got) == [(0, 1.0), (1, 2.0)]
    again = K.add_conditions(chunks.where("rel_chunk = 'c1'"), spark.createDataFrame(got, K.LONG), reg.enabled(["a"]))
    assert again.count() == 2
    with pytest.raises(Exception, match="unusable"):
        K.extract(chunks.withColumn("names", F.array(F.lit("a"))), reg.enabled(["a"])).collect()


def test_windows_must_grow(spark):
    with pytest.raises(ValueError):
        P.window_spans(spark, [[(0.5, 0.4)]], 10)
    assert P.window_spans(spark, [[(0, 0.25), (0.5, 1)]], 10).count() == 2


def test_unknown_subset(spark):
    with pytest.raises(ValueError):
        P.condition_subsets(spark, [["a", "z"]], ["a", "b"])


def test_smoothing_keeps_cubics(spark):
    a = [float(i**3 - i) for i in range(30)]
    got = spark.createDataFrame([(a,)], "a array<double>").select(A.polynomial_smooth(F.col("a"), 9)).first()[0]
    assert got == pytest.approx(a, abs=1e-6)


def test_listing(spark, tmp_path):
    for p in ("x/a.wav", "x/b.MP3", "c.flac", "x/readme.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"1234")
    got = catalog.source_catalog(catalog.list_files(spark, str(tmp_path)), class_name="root").collect()
    assert sorted((r["rel_path"], r["class_name"], r["size_bytes"]) for r in got) == [("c.flac", "root", 4), ("x/a.wav", "x", 4), ("x/b.MP3", "x", 4)]


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ File ,Label,caption\nx/a.wav,one,some text\nx/b.wav,two,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("filename,other\nq,1\n")
    (tmp_path / "c.csv").write_text('FILE_NAME,class\n"x/a.wav","thr,ee"\n')
    got = sidecar.sidecar_scan(spark, str(tmp_path)).collect()
    assert sorted((r["file"], tuple(r["labels"]), tuple(r["texts"])) for r in got) == [("x/a.wav", ("one",), ("some text",)), ("x/a.wav", ("thr,ee",), ()), ("x/b.wav", ("two",), ())]


def test_unmatched_sidecar_rows(spark):
    src = spark.createDataFrame([("en/a.wav",), ("fr/a.wav",)], "rel_path string")
    rows = spark.createDataFrame([(1, "./EN/a.wav", "x", None), (2, "zz/a.wav", "y", None), (3, "none.wav", "z", None)], "pos long, file string, label string, text string")
    got, lost = catalog.attach_sidecar(src, rows)
    assert {r["rel_path"]: r["labels"] for r in got.collect()} == {"en/a.wav": ["x", "y"], "fr/a.wav": ["y"]}
    assert [r["label"] for r in lost.collect()] == ["z"]


def test_beat_folds(spark):
    """The folds over arrays against plain lists: random beats, none, one, many more of either, ties."""
    rng = np.random.default_rng(9)
    lists = lambda n: np.unique(rng.integers(0, 400, n) / 20).tolist()
    rows = [(i, lists(rng.integers(0, 25)), lists(rng.integers(0, 25))) for i in range(60)]
    steady = np.arange(1, 11, dtype=float)
    rows += [(100 + i, steady.tolist(), x.tolist()) for i, x in enumerate((steady, steady + 0.04, steady + 0.25, steady + 0.5, steady[:5], np.arange(1, 10.5, 0.5), steady[::2], steady[:0], steady[:1]))]
    d = spark.createDataFrame([(*r, r[1][::4], r[2][::4]) for r in rows], "k long, ref array<double>, est array<double>, ref_down array<double>, est_down array<double>")
    got = {r["k"]: tuple(r)[1:] for r in B.beat_scores(d, ["k"]).collect()}
    for k, ref, est in rows:
        want = by_force.beat_measures(np.array(ref), np.array(est))
        down = by_force.beat_measures(np.array(ref[::4]), np.array(est[::4]))[0]
        assert got[k] == pytest.approx((*want, down), nan_ok=True), (ref, est)


def test_downbeats_are_snapped(spark):
    of = lambda rows: spark.createDataFrame(rows, "k string, times array<double>")
    got = B.snapped(of([("a", [0.4, 1.5, 1.6, 9.0]), ("none", [2.0, 3.0]), ("empty", [])]), of([("a", [0.0, 1.0, 2.0, 3.0]), ("other", [1.0])]), "k")
    assert {r["k"]: r["times"] for r in got.collect()} == {"a": [0.0, 1.0, 2.0, 3.0], "none": [2.0, 3.0]}


def test_tolerance_match_by_parts(spark):
    """Dense and sparse keys, parted at gaps, against one pass over whole lists; one key with most events."""
    rng = np.random.default_rng(10)
    ev = lambda n, side: [(int(k), float(t) / 100) for k, t in zip(rng.choice([1, 1, 1, 2, 3], n), rng.integers(0, 3000, n), strict=True)]
    ref, est = ev(400, 0), [*ev(300, 1), (7, 1.0)]
    d = lambda rows: spark.createDataFrame([("c", k, t) for k, t in rows], "c string, k int, t double")
    (got,) = B.tolerance_match(d(ref), d(est), ["c"], "k", "t", 0.05).collect()
    want = sum(by_force.greedy_matches(sorted(t for k, t in ref if k == key), sorted(t for k, t in est if k == key), 0.05) for key in (1, 2, 3, 7))
    assert (got["n_ref"], got["n_est"], got["n_match"]) == (400, 301, want)


def test_drums_match_by_class(spark):
    ev = lambda rows: spark.createDataFrame([("c", o, p, d) for o, p, d in rows], "c string, onset double, pitch int, is_drum boolean")
    ref, est = ev([(1.0, 36, True), (2.0, 60, False), (3.0, 200, True)]), ev([(1.01, 35, True), (2.0, 61, False)])
    clips = spark.createDataFrame([("c",), ("empty",)], "c string")
    got = {r["c"]: tuple(r)[1:] for r in S.transcription_scores(ref, est, clips, ["c"]).collect()}
    assert got["c"] == (0, 0, 0, 1, 1, 1) and all(map(math.isnan, got["empty"]))


@pytest.mark.parametrize("part", ["64", "200", "100000"])
def test_split_sidecars(spark, tmp_path, part):
    """Against Python's reader, with files cut at any place."""
    import csv

    rng = np.random.default_rng(11)
    words = ["a", "", "b,c", 'say "hi"', "two\nlines", ",", '"', "\n", "é"]
    for k in range(3):
        with open(tmp_path / f"f{k}.csv", "w", newline="", encoding="utf-8") as fh:
            w = csv.writer(fh, lineterminator="\n", quoting=csv.QUOTE_NONNUMERIC if k == 1 else csv.QUOTE_MINIMAL)
            w.writerow(["n", "Text", "file"] if k < 2 else ["n", "other"])
            w.writerows([[i, *rng.choice(words, 2 if k < 2 else 1)] for i in range(60)])
    want = []
    for k in range(2):
        with open(tmp_path / f"f{k}.csv", newline="", encoding="utf-8") as fh:
            want += [(k, i, r["file"], r["Text"]) for i, r in enumerate(csv.DictReader(fh), 1)]
    with storage.setting(spark, "spark.sql.files.maxPartitionBytes", part):
        got = [(r["file_pos"], r["row_pos"], r["file"] or "", "".join(r["texts"])) for r in sidecar.sidecar_scan(spark, str(tmp_path)).collect()]
    assert sorted(got) == want
