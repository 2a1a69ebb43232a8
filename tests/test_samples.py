"""Assembly of training samples, and the registry of metrics."""

import math

import pytest
from pyspark.sql import functions as F

from chunkline.operators import export as X
from chunkline.operators import metrics
from chunkline.operators import notes as N
from chunkline.operators import report as P

DIMS = [("a", 2, True), ("b", 1, True), ("g", 3, False)]


def tables(spark):
    clips = spark.createDataFrame([("x", 0), ("x", 3), ("x", 5), ("y", 7), ("z", 0)], "rel_chunk string, start long")
    rows = [("x", "a", f, [float(f), -float(f)]) for f in range(9)] + [("x", "b", f, [float(f)]) for f in range(9) if f != 4] + [("x", "g", None, [1.0, 2.0, 3.0]), ("y", "a", 7, [1.0, 1.0]), ("y", "other", 7, [9.0])]
    return clips, spark.createDataFrame(rows, "rel_chunk string, name string, frame int, v array<float>"), spark.createDataFrame(DIMS, "name string, dim int, per_frame boolean")


def test_clips_at_any_start(spark):
    clips, rows, dims = tables(spark)
    got = {(r["rel_chunk"], r["start"]): r for r in X.clip_samples(clips, rows, dims, 4, ["a", "b", "g"]).collect()}
    assert len(got) == 5
    assert got["x", 3]["a"] == [[f, -f] for f in (3.0, 4.0, 5.0, 6.0)] and got["x", 5]["b"] == [[5.0], [6.0], [7.0], [8.0]]
    assert got["x", 3]["b"] is None and got["x", 3]["b_mask"] == [True, False, True, True]
    assert got["x", 0]["g"] == [1.0, 2.0, 3.0] and got["y", 7]["g"] is None and not got["y", 7]["g_given"] and got["z", 0]["a_mask"] == [False] * 4


def test_missing_frames_are_zeros(spark):
    clips, rows, dims = tables(spark)
    got = {(r["rel_chunk"], r["start"]): r for r in X.clip_samples(clips, rows, dims, 4, ["g", "a", "b"], strict=False).collect()}
    assert got["x", 3]["b"] == [[3.0], [0.0], [5.0], [6.0]] and got["y", 7]["a"] == [[1.0, 1.0]] + [[0.0, 0.0]] * 3
    assert got["z", 0]["g"] == [0.0] * 3 and got["z", 0]["a"] == [[0.0, 0.0]] * 4
    assert X.clip_samples(clips.limit(0), rows, dims, 4, ["a", "g"]).count() == 0
    assert X.clip_samples(clips, rows.limit(0), dims, 4, ["a", "g"], strict=False).count() == 5
    with pytest.raises(ValueError, match="unknown"):
        X.clip_samples(clips, rows, dims, 4, ["a", "q"])
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY|Duplicate map key"):
        X.clip_samples(clips, rows.unionByName(rows.where("name = 'a'")), dims, 4, ["a"]).collect()


def test_samples_of_a_source_clock(spark):
    d = spark.createDataFrame([(3, 48000), (0, 44100), (5, 22050)], "start long, rate int")
    got = [(r["lo"], r["hi"]) for r in P.sample_spans(d, 20, 512, 44100).orderBy("start").collect()]
    per = lambda rate: 512 * rate / 44100
    assert got == [(0, 20 * 512), (round(3 * per(48000)), round(23 * per(48000))), (round(5 * 256), round(25 * 256))]


def roll_frames(spark, target, generated, frames=12):
    """One sample; lit slots by frame."""
    width = N.DRUM0 + len(N.DRUMS)
    rows = [("s", f, [1.0 if (f, s) in target else 0.0 for s in range(width)], [1.0 if (f, s) in generated else 0.0 for s in range(width)]) for f in range(frames)]
    return spark.createDataFrame(rows, "sample string, frame int, target array<double>, generated array<double>")


def lit(notes, drums):
    return {(f, k) for a, b, k in notes for f in range(a, b)} | {(a, N.ONSET0 + k) for a, b, k in notes} | {(f, N.DRUM0 + k) for f, k in drums}


def test_every_condition_has_both_families(spark):
    assert set(metrics.MIR) == {"f0", "chroma", "chord", "rhythm", "midi"} and set(metrics.OWN) == {"chroma", "chord", "rhythm", "energy", "f0", "midi"}
    with pytest.raises(ValueError):
        metrics.metric_for("tempo", "mir")
    assert metrics.metric_for("energy", "mir") is metrics.OWN["energy"]


def test_midi_metrics(spark):
    target = lit([(0, 4, 40), (6, 9, 41)], [(2, 0), (5, 3)])
    generated = lit([(0, 2, 40), (6, 9, 50)], [(2, 0)])
    frames = roll_frames(spark, target, generated)
    (got,) = metrics.metric_for("midi", "mir")(frames, ["sample"], "target", "generated", fps=10.0).collect()
    assert tuple(got)[1:] == pytest.approx((0.5, 0.5, 0.5, 1.0, 0.5, 2 / 3))
    (same,) = metrics.metric_for("midi")(roll_frames(spark, target, target), ["sample"], "target", "generated").collect()
    assert same["onset_corr"] == pytest.approx(1) and same["drum_corr"] == pytest.approx(1)
    (none,) = metrics.metric_for("midi", "mir")(roll_frames(spark, set(), set()), ["sample"], "target", "generated").collect()
    assert all(map(math.isnan, tuple(none)[1:]))


def test_rhythm_metrics(spark):
    beat = lambda on: F.when(F.col("frame").isin(*on), 1.0).otherwise(0.0)
    d = spark.range(100).select(F.lit(1).alias("sample"), F.col("id").cast("int").alias("frame"))
    d = d.select("sample", "frame", F.array(beat([10, 30, 50, 70]), beat([10, 51])).alias("target"), F.array(beat([10, 30, 50, 71]), beat([11, 50])).alias("generated"))
    rows = {r["metric"]: r["value"] for r in metrics.evaluate({"rhythm": d}, "sample", "target", "generated", "mir", fps=50.0).collect()}
    assert rows["beat_f_measure"] == 1 and rows["downbeat_f_measure"] == 1 and rows["beat_cmlt"] == 1 and set(rows) == {"beat_f_measure", "beat_cemgil", "beat_p_score", "beat_cmlt", "beat_amlt", "downbeat_f_measure"}
    own = {r["metric"]: r["value"] for r in metrics.evaluate({"rhythm": d}, "sample", "target", "generated").collect()}
    assert 0.7 < own["beat_corr"] < 0.8 and own["downbeat_corr"] < 0.1
