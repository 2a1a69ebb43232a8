"""Queries over samples, chunks and frame series, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkline.functions import series as A
from chunkline.operators import chunks as C
from chunkline.operators import frames as R
from chunkline.plans.fixtures import view
from chunkline.plans.notes import GRID, PEAKS
from chunkline.plans.registry import Family

family = Family()
query = family.query


def samples(spark, sf):
    return view(spark, sf, "fx_samples")


def arrays(spark, sf):
    return R.as_array(samples(spark, sf), "clip_id", "seq", "x")


def rounded(name: str = "a"):
    return lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(name)


ARR = "arr AS (SELECT clip_id, list(x ORDER BY seq) AS a FROM fx_samples GROUP BY clip_id)"
LIN = "list_transform(range({m}), lambda k: round(a[floor({pos})::BIGINT + 1] + ({pos} - floor({pos})) * (a[least(floor({pos})::BIGINT + 2, len(a))] - a[floor({pos})::BIGINT + 1]), 6))"


@query("b10_frames_per_clip", "SELECT doc_id, name, CASE WHEN size_bytes = 500 THEN floor(5 * fps) ELSE floor(size_bytes / 100.0 * fps) END::BIGINT AS frames FROM fx_sources, (VALUES ('a', 44100 / 512.0), ('b', 32000 / 640.0)) c(name, fps)")
def b10(spark, sf):
    codecs = spark.createDataFrame([("a", 44100 / 512.0), ("b", 32000 / 640.0)], "name string, fps double")
    src = view(spark, sf, "fx_sources").crossJoin(F.broadcast(codecs))
    whole = F.floor(F.lit(5) * F.col("fps"))
    frames = F.when(F.col("size_bytes") == 500, whole).otherwise(F.floor(F.col("size_bytes") / 100.0 * F.col("fps")))
    return src.select("doc_id", "name", frames.cast("long").alias("frames"))


@query("b11_mean_dbfs", "SELECT clip_id, round(20 * log10(avg(abs(x)) + 1e-7), 6) AS dbfs FROM fx_samples GROUP BY clip_id")
def b11(spark, sf):
    return samples(spark, sf).groupBy("clip_id").agg(F.round(C.mean_dbfs(F.col("x")), 6).alias("dbfs"))


PN = "CASE WHEN target > 0 THEN 0.05 + 0.95 * (log2(greatest(least(target, 1000), 50)) - log2(50)) / (log2(1000) - log2(50) + 1e-8) ELSE 0 END"


@query("b12_pitch_norm", f"SELECT clip_id, frame, round(p, 6) AS norm, round(CASE WHEN p > 0 THEN pow(2, log2(50) + greatest(least((p - 0.05) / 0.95, 1), 0) * (log2(1000) - log2(50) + 1e-8)) ELSE 0 END, 4) AS hz FROM (SELECT clip_id, frame, {PN} AS p FROM fx_curves)")
def b12(spark, sf):
    c = view(spark, sf, "fx_curves").withColumn("p", A.pitch_norm(F.col("target")))
    return c.select("clip_id", "frame", F.round("p", 6).alias("norm"), F.round(A.pitch_hz(F.col("p")), 4).alias("hz"))


@query("b13_energy_norm", "SELECT clip_id, seq, round(greatest(least((20 * log10(x + 1e-7) + 80) / 80, 1), 0), 6) AS e FROM fx_samples")
def b13(spark, sf):
    return samples(spark, sf).select("clip_id", "seq", F.round(A.energy_norm(F.col("x")), 6).alias("e"))


@query("b14_logit_curves", "SELECT clip_id, frame, round(1 / (1 + exp(-(target - generated) / 50)), 6) AS p FROM fx_curves")
def b14(spark, sf):
    return view(spark, sf, "fx_curves").select("clip_id", "frame", F.round(A.logit_curve((F.col("target") - F.col("generated")) / 50), 6).alias("p"))


@query("b15_resample_linear", f"WITH {ARR} SELECT clip_id, {LIN.format(m=20, pos='(k * (len(a) - 1) / 19)')} AS a FROM arr")
def b15(spark, sf):
    return arrays(spark, sf).select("clip_id", rounded()(A.resample_linear(F.col("a"), 20)))


@query("b16_resample_nearest", f"WITH {ARR} SELECT clip_id, list_transform(range(20), lambda k: round(a[greatest(ceil(k * (len(a) - 1) / 19 - 0.5), 0)::BIGINT + 1], 6)) AS a FROM arr")
def b16(spark, sf):
    return arrays(spark, sf).select("clip_id", rounded()(A.resample_nearest(F.col("a"), 20)))


@query("b17_resample_clock", f"WITH {ARR} SELECT clip_id, {LIN.format(m=40, pos='least(k * 1.6::DOUBLE, len(a) - 1)')} AS a FROM arr")
def b17(spark, sf):
    return arrays(spark, sf).select("clip_id", rounded()(A.resample_clock(F.col("a"), 40, 80, 50)))


@query("b18_align_pad", f"WITH {ARR} SELECT clip_id, list_transform(range(60), lambda k: round(coalesce(a[k + 1], 0), 6)) AS a FROM arr")
def b18(spark, sf):
    return arrays(spark, sf).select("clip_id", rounded()(A.align_pad(F.col("a"), 60, F.lit(0.0))))


@query("b23_loudness_gain", "SELECT event_id, round(CASE WHEN i IS NOT NULL THEN least(-14 - i, -1 - tp) END, 6) AS gain FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE -value / 10 END AS i, value / 100 - 3 AS tp FROM events)")
def b23(spark, sf):
    e = view(spark, sf, "events")
    i = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(-F.col("value") / 10)
    return e.select("event_id", F.round(C.loudness_gain(-14.0, -1.0, i, F.col("value") / 100 - 3), 6).alias("gain"))


REG = """reg AS (SELECT clip_id, onset_s - 20 AS s, CASE WHEN is_drum THEN NULL ELSE offset_s - 20 END AS e, d AS duration
  FROM (SELECT *, max(offset_s) OVER (PARTITION BY clip_id) - 20 AS d FROM fx_notes))"""


def regions(spark, sf):
    n = view(spark, sf, "fx_notes")
    d = n.groupBy("clip_id").agg((F.max("offset_s") - 20).alias("duration"))
    return n.join(d, "clip_id").select("clip_id", "duration", (F.col("onset_s") - 20).alias("s"), F.when(~F.col("is_drum"), F.col("offset_s") - 20).alias("e"))


TRIM = f"""WITH {REG}, t AS (SELECT clip_id, duration, CASE WHEN min(s) < 0.05 THEN arg_min(coalesce(e, duration), s) ELSE 0 END AS b,
  CASE WHEN arg_max(coalesce(e, duration), s) >= duration - 0.05 THEN max(s) ELSE duration END AS z FROM reg GROUP BY clip_id, duration)"""


@query("b24_trim_points", TRIM + " SELECT clip_id, round(duration, 6) AS duration, round(b, 6) AS begin, round(z, 6) AS stop FROM t")
def b24(spark, sf):
    t = C.trim_points(regions(spark, sf), "clip_id")
    return t.select("clip_id", *[F.round(c, 6).alias(c) for c in ("duration", "begin", "stop")])


@query("c6_min_sec_gate", TRIM + " SELECT clip_id FROM t WHERE z - b >= 700")
def c6(spark, sf):
    return C.trim_points(regions(spark, sf), "clip_id").where(F.col("stop") - F.col("begin") >= 700).select("clip_id")


@query("c1_head_and_clip", "SELECT clip_id, seq, round(greatest(least(x, 0.2), -0.2), 6) AS x FROM fx_samples WHERE seq < 50 AND clip_id IN (SELECT clip_id FROM fx_samples GROUP BY clip_id HAVING count(*) >= 65)")
def c1(spark, sf):
    s = samples(spark, sf)
    kept = s.join(C.source_gates(s, "clip_id", min_len=65), "clip_id", "left_semi")
    return C.head_and_clip(kept, 50, 0.2).select("clip_id", "seq", F.round("x", 6).alias("x"))


@query("c2_peak_ratio_gate", "SELECT clip_id FROM fx_samples GROUP BY clip_id HAVING avg((abs(x) >= 0.2)::INT) <= 0.1")
def c2(spark, sf):
    return C.source_gates(samples(spark, sf), "clip_id", peak=0.2, max_peak_ratio=0.1)


@query("c3_silence_ratio_gate", "SELECT clip_id FROM fx_samples GROUP BY clip_id HAVING avg((abs(x) < 0.05)::INT) < 0.4")
def c3(spark, sf):
    return C.source_gates(samples(spark, sf), "clip_id", silence=0.05, max_silence_ratio=0.4)


CUT = """cut AS (SELECT s.clip_id, k * 12 AS start, seq - k * 12 AS seq, x FROM fx_samples s
  JOIN (SELECT clip_id, unnest(range((max(seq) + 1 - 16) // 12 + 1)) AS k FROM fx_samples GROUP BY clip_id HAVING max(seq) + 1 >= 16) c
  ON s.clip_id = c.clip_id AND seq >= k * 12 AND seq < k * 12 + 16),
lv AS (SELECT clip_id, start, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, 20 * log10(avg(abs(x)) + 1e-7) AS dbfs FROM cut GROUP BY ALL)"""


def levels(spark, sf):
    return C.chunk_levels(C.cut_chunks(samples(spark, sf), "clip_id", 16, 4), "clip_id")


@query("c4_chunk_energy_gate", f"WITH {CUT} SELECT clip_id, start, round(rms, 6) AS rms, round(peak, 6) AS peak FROM lv WHERE rms > 0.13 OR peak > 0.4")
def c4(spark, sf):
    kept = levels(spark, sf).where(C.energy_gate(0.13, 0.4))
    return kept.select("clip_id", "start", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"))


@query("c5_dbfs_gate", f"WITH {CUT}, n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start) - 1 AS idx FROM lv WHERE rms > 0.1) SELECT clip_id, start, idx FROM n WHERE dbfs >= -21")
def c5(spark, sf):
    return C.numbered_chunks(levels(spark, sf), "clip_id", rms=0.1, min_dbfs=-21.0).select("clip_id", "start", "idx")


@query("f1_chunk_windows", "SELECT doc_id, CASE WHEN size_bytes >= 512 THEN range(0, ((size_bytes - 512) // 448 + 1) * 448, 448) ELSE [] END AS every, CASE WHEN size_bytes >= 512 THEN list_sort(list_distinct(list_transform(range(4), lambda k: floor(((size_bytes - 512) // 448 + 1) * (2 * k + 1) / 8)::BIGINT * 448))) ELSE [] END AS kept FROM fx_sources")
def f1(spark, sf):
    src = view(spark, sf, "fx_sources")
    return src.select("doc_id", C.window_starts(F.col("size_bytes"), 512, 64).alias("every"), F.array_sort(C.window_starts(F.col("size_bytes"), 512, 64, keep=4)).alias("kept"))


@query("f2_chunk_numbering", f"""WITH {CUT}, l AS (SELECT clip_id, max(seq) + 1 AS length FROM fx_samples GROUP BY clip_id),
t AS (SELECT clip_id, start, unnest(range(16)) AS seq FROM (SELECT clip_id, length, CASE WHEN length >= 16 THEN ((length - 16) // 12 + 1) * 12 ELSE 0 END AS start FROM l) WHERE start < length),
p AS (SELECT t.clip_id, start, t.seq, coalesce(x, 0) AS x FROM t LEFT JOIN fx_samples s ON s.clip_id = t.clip_id AND s.seq = t.start + t.seq),
a AS (SELECT clip_id, start, sqrt(avg(x * x)) AS rms FROM (SELECT * FROM cut UNION ALL SELECT * FROM p) GROUP BY ALL)
SELECT clip_id, start, row_number() OVER (PARTITION BY clip_id ORDER BY start) - 1 AS idx FROM a WHERE rms > 0.1""")
def f2(spark, sf):
    s = samples(spark, sf)
    rows = C.cut_chunks(s, "clip_id", 16, 4).unionByName(C.padded_tail(s, "clip_id", 16, 4))
    return C.numbered_chunks(C.chunk_levels(rows, "clip_id"), "clip_id", rms=0.1).select("clip_id", "start", "idx")


@query("f3_clips_per_chunk", "SELECT clip_id, frames, unnest(range(frames // 20)) * 20 AS start FROM (SELECT clip_id, count(*) AS frames FROM fx_samples GROUP BY clip_id)")
def f3(spark, sf):
    return C.clips_per_chunk(samples(spark, sf).groupBy("clip_id").agg(F.count("*").alias("frames")), 20)


@query("f4_median_smooth", "SELECT clip_id, seq, round(list_sort(list(x) OVER w || list_transform(range(5 - count(*) OVER w), lambda i: 0.0::DOUBLE))[3], 6) AS x FROM fx_samples WINDOW w AS (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def f4(spark, sf):
    return R.median_smooth(samples(spark, sf), "clip_id", "seq", "x", 5).select("clip_id", "seq", F.round("x", 6).alias("x"))


@query("f5_moving_energy_mask", "SELECT clip_id, seq // 4 AS frame, 20 * log10(sqrt(e + 1e-12) + 1e-9) < -20 AS silent FROM (SELECT clip_id, seq, sum(x * x) OVER (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8 AS e FROM fx_samples) WHERE seq % 4 = 0")
def f5(spark, sf):
    return R.moving_energy_mask(samples(spark, sf), "clip_id", "seq", "x", 8, 4, -20.0)


@query("f6_drop_short_runs", """WITH m AS (SELECT clip_id, frame, target > 0 AS voiced FROM fx_curves),
i AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - row_number() OVER (PARTITION BY clip_id, voiced ORDER BY frame) AS g FROM m)
SELECT clip_id, frame, voiced AND count(*) OVER (PARTITION BY clip_id, voiced, g) >= 3 AS voiced FROM i""")
def f6(spark, sf):
    c = view(spark, sf, "fx_curves").select("clip_id", "frame", (F.col("target") > 0).alias("voiced"))
    return R.drop_short_runs(c, "clip_id", "frame", "voiced", 3)


_W = str([[float(x) for x in row] for row in A.polynomial_weights(9)])


@query("f7_polynomial_smooth", f"WITH {ARR} SELECT clip_id, CASE WHEN len(a) >= 9 THEN list_transform(range(len(a)), lambda i: round(list_dot_product({_W}[i - greatest(least(i - 4, len(a) - 9), 0) + 1], a[greatest(least(i - 4, len(a) - 9), 0) + 1 : greatest(least(i - 4, len(a) - 9), 0) + 9]), 6)) ELSE list_transform(a, lambda v: round(v, 6)) END AS a FROM arr")
def f7(spark, sf):
    return arrays(spark, sf).select("clip_id", rounded()(A.polynomial_smooth(F.col("a"), 9)))


@query("f9_peak_times", f"WITH RECURSIVE {GRID}, {PEAKS.format(n='pk', v='target')} SELECT clip_id, list_transform(t, lambda x: round(x, 6)) AS times FROM pk")
def f9(spark, sf):
    c = R.zero_filled(view(spark, sf, "fx_curves"), "clip_id", 31, "target").withColumn("target", F.col("target") / 100)
    return R.peak_times(c, "clip_id", "frame", "target", 10.0).select("clip_id", rounded("times")(F.col("times")))


@query("f13_silence_to_zero", "SELECT clip_id, seq, round(CASE WHEN 20 * log10(x + 1e-9) < -20 THEN 0 ELSE x END, 6) AS y FROM fx_samples")
def f13(spark, sf):
    return R.silence_to_zero(samples(spark, sf).withColumn("y", F.col("x")), "y", "x", -20.0).select("clip_id", "seq", F.round("y", 6).alias("y"))
