"""Queries over notes, beats and per-clip scores, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkline.functions.series import signed_round
from chunkline.operators import beats as B
from chunkline.operators import frames as R
from chunkline.operators import notes as N
from chunkline.operators import scores as S
from chunkline.plans.fixtures import view
from chunkline.plans.registry import Family
from chunkline.sources.storage import staged

family = Family()
query = family.query

T = 744


def notes(spark, sf):
    return view(spark, sf, "fx_notes").withColumnsRenamed({"onset_s": "onset", "offset_s": "offset"})


def cells(spark, sf):
    return N.notes_to_cells(notes(spark, sf), ["clip_id", "side"], 1.0, T)


def rounded(df, *names):
    return df.select(*[signed_round(F.col(c), 6).alias(c) if c in names else c for c in df.columns])


DRUM = "MAP {" + ", ".join(f"{p}: {k}" for k, ps in enumerate(N.DRUMS) for p in ps) + "}[pitch]"
CELLS = f"""q AS (SELECT clip_id, side, onset_s AS s, offset_s AS e, round_even(onset_s, 0)::BIGINT AS a, pitch, is_drum, {DRUM} AS k FROM fx_notes WHERE offset_s > 0 AND onset_s < {T}),
cells AS (SELECT DISTINCT clip_id, side, unnest(range(greatest(a, 0), least(greatest(round_even(e, 0)::BIGINT, a + 1), {T}))) AS frame, pitch - 21 AS slot FROM q WHERE NOT is_drum
  UNION SELECT clip_id, side, a, pitch - 21 + 88 FROM q WHERE NOT is_drum AND s >= 0 AND a < {T}
  UNION SELECT clip_id, side, a, 176 + k FROM q WHERE is_drum AND k IS NOT NULL AND s >= 0 AND a < {T})"""


@query("b21_drum_class", f"SELECT clip_id, pitch, count(*) AS n, {DRUM} AS drum FROM fx_notes WHERE is_drum GROUP BY ALL")
def b21(spark, sf):
    n = notes(spark, sf).where("is_drum").groupBy("clip_id", "pitch").agg(F.count("*").alias("n"))
    return n.withColumn("drum", N.drum_class(F.col("pitch")))


@query("f10_notes_to_frames", f"WITH {CELLS} SELECT clip_id, side, frame, slot FROM cells")
def f10(spark, sf):
    return cells(spark, sf)


@query("d12_notes_in_chunk", "SELECT n.clip_id, side, t0, pitch, round(onset_s - t0, 6) AS onset, round(offset_s - t0, 6) AS offset_ FROM fx_notes n, (SELECT clip_id, unnest(range(37)) * 20.0 + clip_id % 3 AS t0 FROM (SELECT DISTINCT clip_id FROM fx_notes)) w WHERE n.clip_id = w.clip_id AND offset_s - t0 > 0 AND onset_s - t0 < 20")
def d12(spark, sf):
    n = notes(spark, sf)
    starts = n.select("clip_id").distinct().select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(36))).alias("i"))
    windows = starts.select("clip_id", (F.col("i") * 20.0 + F.col("clip_id") % 3).alias("t0"))
    met = N.notes_in_windows(n, windows, "clip_id", 20.0)
    return met.select("clip_id", "side", "t0", "pitch", F.round("onset", 6).alias("onset"), F.round("offset", 6).alias("offset_"))


@query(
    "f11_frames_to_notes",
    f"""WITH {CELLS}, l AS (SELECT clip_id, side, slot % 88 AS key, frame, bool_or(slot < 88) AS sounds, bool_or(slot >= 88) AS starts FROM cells WHERE slot < 176 GROUP BY ALL),
    c AS (SELECT *, starts OR NOT sounds OR coalesce(frame - lag(frame) OVER w > 1, true) AS cut FROM l WINDOW w AS (PARTITION BY clip_id, side, key ORDER BY frame)),
    r AS (SELECT *, sum(cut::INT) OVER (PARTITION BY clip_id, side, key ORDER BY frame) AS run FROM c)
    SELECT clip_id, side, key + 21 AS pitch, min(frame) AS start, max(frame) + 1 AS stop FROM r GROUP BY clip_id, side, key, run HAVING bool_or(starts)""",
)
def f11(spark, sf):
    return N.cells_to_notes(cells(spark, sf), ["clip_id", "side"])


@query(
    "f12_pair_on_off",
    """WITH b AS (SELECT *, sum(CASE kind WHEN 'on' THEN 1 ELSE -1 END) OVER (PARTITION BY clip_id, note ORDER BY ts, event_id) AS bal FROM fx_msgs),
    m AS (SELECT *, least(coalesce(min(bal) OVER (PARTITION BY clip_id, note ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS low FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, note, kind ORDER BY ts, event_id) AS r FROM m WHERE kind = 'on' OR bal >= low),
    z AS (SELECT clip_id, max(ts) AS z FROM fx_msgs GROUP BY clip_id)
    SELECT a.clip_id, a.note, a.ts AS start, coalesce(f.ts, z) AS stop FROM r a LEFT JOIN r f ON f.kind = 'off' AND a.clip_id = f.clip_id AND a.note = f.note AND a.r = f.r JOIN z ON z.clip_id = a.clip_id WHERE a.kind = 'on'""",
)
def f12(spark, sf):
    return N.pair_on_off(view(spark, sf, "fx_msgs"), ["clip_id"], ["ts", "event_id"], "ts")


@query(
    "d13_nearest_event",
    """SELECT p.clip_id, round(p.onset_s, 6) AS onset, round(arg_min(e.onset_s, (abs(e.onset_s - p.onset_s), e.onset_s)), 6) AS nearest
    FROM (SELECT clip_id, onset_s FROM fx_notes WHERE is_drum) p JOIN (SELECT clip_id, onset_s FROM fx_notes WHERE NOT is_drum) e ON p.clip_id = e.clip_id GROUP BY p.clip_id, p.onset_s""",
)
def d13(spark, sf):
    n = notes(spark, sf)
    near = N.nearest_event(n.where("is_drum"), n.where("not is_drum"), "clip_id", "onset")
    return rounded(near, "onset", "nearest").distinct()


def two_sides(spark, sf):
    """Notes and drums; pitches of notes are folded, so that many meet."""
    n = notes(spark, sf).withColumn("pitch", F.when(F.col("is_drum"), F.col("pitch")).otherwise(F.col("pitch") % 4))
    return n.where("side = 0"), n.where("side = 1")


#: Two pointers over the sorted times of both sides of each key.
MATCH = """{n}_l AS (SELECT {k}, coalesce(list(t ORDER BY t) FILTER (side = 0), []) AS r, coalesce(list(t ORDER BY t) FILTER (side = 1), []) AS e FROM {s} GROUP BY ALL),
{n}_w AS (SELECT {k}, r, e, 1 AS i, 1 AS j, 0 AS m FROM {n}_l UNION ALL
  SELECT {k}, r, e, i + CASE WHEN round(e[j] - r[i], 4) >= -{tol} THEN 1 ELSE 0 END, j + CASE WHEN round(e[j] - r[i], 4) <= {tol} THEN 1 ELSE 0 END, m + CASE WHEN abs(round(e[j] - r[i], 4)) <= {tol} THEN 1 ELSE 0 END
  FROM {n}_w WHERE i <= len(r) AND j <= len(e)),
{n} AS (SELECT {k}, len(r) AS nr, len(e) AS ne, max(m) AS m FROM {n}_w GROUP BY ALL)"""
_DRUM = ", ".join(f"({p}, {k})" for k, ps in enumerate(N.DRUMS) for p in ps)
EVENTS = f"""ev AS (SELECT clip_id, is_drum, side, onset_s AS t, CASE WHEN is_drum THEN 100 + d.k ELSE fx_notes.pitch % 4 END AS slot FROM fx_notes LEFT JOIN (VALUES {_DRUM}) d(p, k) ON d.p = fx_notes.pitch WHERE NOT is_drum OR d.k IS NOT NULL),
""" + MATCH.format(n="mt", k="clip_id, is_drum, slot", s="ev", tol=20.0) + """,
tot AS (SELECT clip_id, is_drum, sum(nr)::BIGINT AS n_ref, sum(ne)::BIGINT AS n_est, sum(m)::BIGINT AS n_match FROM mt GROUP BY ALL)"""


@query("d14_tolerance_match", f"WITH RECURSIVE {EVENTS} SELECT clip_id, is_drum, n_ref, n_est, n_match FROM tot")
def d14(spark, sf):
    slot = F.when(F.col("is_drum"), N.drum_class(F.col("pitch"))).otherwise(F.col("pitch"))
    ref, est = (d.withColumn("slot", slot).where("slot is not null") for d in two_sides(spark, sf))
    return B.tolerance_match(ref, est, ["clip_id", "is_drum"], "slot", "onset", 20.0)


PRF = """CASE WHEN coalesce(n_ref, 0) = 0 AND coalesce(n_est, 0) = 0 THEN 'NaN' WHEN n_est = 0 THEN 'NaN' ELSE round(n_match / n_est, 6) END::DOUBLE AS {n}_precision,
CASE WHEN coalesce(n_ref, 0) = 0 THEN 'NaN' ELSE round(n_match / n_ref, 6) END::DOUBLE AS {n}_recall, CASE WHEN coalesce(n_ref, 0) = 0 THEN 'NaN' WHEN n_match = 0 THEN 0 ELSE round(2 * n_match / (n_ref + n_est), 6) END::DOUBLE AS {n}_f1"""


@query(
    "e21_transcription_scores",
    f"WITH RECURSIVE {EVENTS}, cl AS (SELECT DISTINCT clip_id FROM fx_notes), a AS (SELECT clip_id, {PRF.format(n='note')} FROM cl LEFT JOIN (SELECT * FROM tot WHERE NOT is_drum) t USING (clip_id)), b AS (SELECT clip_id, {PRF.format(n='drum')} FROM cl LEFT JOIN (SELECT * FROM tot WHERE is_drum) t USING (clip_id)) SELECT * FROM a JOIN b USING (clip_id)",
)
def e21(spark, sf):
    s = S.transcription_scores(*two_sides(spark, sf), notes(spark, sf), ["clip_id"], 20.0)
    return rounded(s, *s.columns[1:])


_K = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in N.gaussian_kernel(2.0))
GAUSS = f"g AS (SELECT clip_id, side, slot, frame + k AS frame, sum(w) AS v FROM cells, (VALUES {_K}) t(k, w) WHERE frame + k BETWEEN 0 AND {T - 1} GROUP BY clip_id, side, slot, frame + k)"


@query("f8_gaussian_smooth", f"WITH {CELLS.replace('cells AS', 'every AS')}, cells AS (SELECT * FROM every WHERE slot >= 88), {GAUSS} SELECT clip_id, side, slot, frame, round(v, 6) AS v FROM g")
def f8(spark, sf):
    return rounded(N.gaussian_smooth(cells(spark, sf).where("slot >= 88"), ["clip_id", "side"], 2.0, T), "v")


CORR = """{n} AS (SELECT clip_id, CASE WHEN sum(y) = 0 THEN 0 WHEN sqrt(greatest(sum(x * x) - sum(x) * sum(x) / {c}, 0)) * sqrt(greatest(sum(y * y) - sum(y) * sum(y) / {c}, 0)) > 1e-8
  THEN (sum(x * y) - sum(x) * sum(y) / {c}) / (sqrt(sum(x * x) - sum(x) * sum(x) / {c}) * sqrt(sum(y * y) - sum(y) * sum(y) / {c})) ELSE 'NaN'::DOUBLE END AS r
  FROM (SELECT clip_id, slot, frame, coalesce(sum(v) FILTER (side = 0), 0) AS x, coalesce(sum(v) FILTER (side = 1), 0) AS y FROM g WHERE slot BETWEEN {lo} AND {hi} GROUP BY ALL) GROUP BY clip_id HAVING sum(x) > 0)"""


@query(
    "e17_roll_fidelity",
    f"WITH {CELLS}, {GAUSS}, " + CORR.format(n="o", c=88 * T, lo=88, hi=175) + ", " + CORR.format(n="d", c=9 * T, lo=176, hi=184) + """,
    f AS (SELECT clip_id, frame, slot, count(*) FILTER (side = 0) AS t, count(*) FILTER (side = 1) AS q FROM cells WHERE slot < 88 GROUP BY ALL),
    h AS (SELECT clip_id, frame, sum(t) AS nt, sum(q) AS nq, sum(t * q) AS b FROM f GROUP BY ALL),
    c AS (SELECT clip_id, avg(CASE WHEN nt > 0 AND nq > 0 THEN b / sqrt(nt * nq) ELSE 0 END) AS r FROM h GROUP BY clip_id)
    SELECT clip_id, round(coalesce(c.r, 'NaN'::DOUBLE), 6) AS cosine, round(coalesce(o.r, 'NaN'::DOUBLE), 6) AS onset_corr, round(coalesce(d.r, 'NaN'::DOUBLE), 6) AS drum_corr
    FROM (SELECT DISTINCT clip_id FROM fx_notes) LEFT JOIN c USING (clip_id) LEFT JOIN o USING (clip_id) LEFT JOIN d USING (clip_id)""",
)
def e17(spark, sf):
    c = staged(cells(spark, sf), "cells")
    s = S.roll_fidelity(c.where("side = 0").drop("side"), c.where("side = 1").drop("side"), notes(spark, sf), ["clip_id"], T)
    return rounded(s, "cosine", "onset_corr", "drum_corr")


def pairs(spark, sf):
    """Frames of a real clip beside those of the generated clip after it."""
    c = view(spark, sf, "fx_clips").withColumn("pair", F.floor(F.col("clip_id") / 2))
    real, gen = (c.where(F.col("side") == s).select("pair", "frame", F.col("embedding").alias(s)) for s in ("real", "gen"))
    return real.join(gen, ["pair", "frame"])


PAIR = "p AS (SELECT r.clip_id // 2 AS pair, r.frame, r.embedding AS t, g.embedding AS g FROM fx_clips r JOIN fx_clips g ON r.clip_id + 1 = g.clip_id AND r.frame = g.frame WHERE r.side = 'real')"


@query("e15_cosine_fidelity", f"WITH {PAIR} SELECT pair, round(avg(list_cosine_similarity(t::DOUBLE[], g::DOUBLE[])), 6) AS score FROM p GROUP BY pair")
def e15(spark, sf):
    return rounded(S.cosine_fidelity(pairs(spark, sf), ["pair"], "real", "gen"), "score")


@query("e16_pearson_fidelity", """SELECT clip_id, round(CASE WHEN count(*) FILTER (target > 0) >= 2 AND stddev_pop(target) FILTER (target > 0) > 0 AND stddev_pop(generated) FILTER (target > 0) > 0 THEN corr(target, generated) FILTER (target > 0) ELSE 'NaN'::DOUBLE END, 6) AS score FROM fx_curves GROUP BY clip_id""")
def e16(spark, sf):
    return rounded(S.pearson_fidelity(view(spark, sf, "fx_curves"), ["clip_id"], "target", "generated", voiced_only=True), "score")


@query(
    "e18_melody_scores",
    """WITH d AS (SELECT clip_id, target AS r, generated AS e, 1200 * (log2(CASE WHEN generated > 0 THEN generated END) - log2(CASE WHEN target > 0 THEN target END)) AS c FROM fx_curves),
    k AS (SELECT clip_id, count(*) AS n, count(*) FILTER (r > 0) AS v, count(*) FILTER (r > 0 AND e > 0) AS vv, count(*) FILTER (r <= 0 AND e > 0) AS fa, count(*) FILTER (r <= 0 AND e <= 0) AS uu,
      count(*) FILTER (abs(c) < 50) AS hit, count(*) FILTER (abs(c - 1200 * floor(c / 1200 + 0.5)) < 50) AS chit FROM d GROUP BY clip_id)
    SELECT clip_id, round(CASE WHEN v > 0 THEN hit / v ELSE 'NaN' END, 6) AS raw_pitch_accuracy, round(CASE WHEN v > 0 THEN chit / v ELSE 'NaN' END, 6) AS raw_chroma_accuracy, round(CASE WHEN v > 0 THEN vv / v ELSE 'NaN' END, 6) AS voicing_recall,
      round(CASE WHEN n > v THEN fa / (n - v) ELSE 'NaN' END, 6) AS voicing_false_alarm, round((hit + uu) / n, 6) AS overall_accuracy FROM k""",
)
def e18(spark, sf):
    s = S.melody_scores(view(spark, sf, "fx_curves"), ["clip_id"], "target", "generated")
    return rounded(s, *s.columns[1:])


@query(
    "e19_multipitch_scores",
    f"""WITH {PAIR}, f AS (SELECT pair, len(list_filter(range(1, 13), lambda i: t[i] >= 0.1 AND g[i] >= 0.1)) AS tp, len(list_filter(t[1:12], lambda x: x >= 0.1)) AS r, len(list_filter(g[1:12], lambda x: x >= 0.1)) AS e FROM p),
    k AS (SELECT pair, sum(tp) AS tp, sum(r) AS r, sum(e) AS e, sum(greatest(r - e, 0)) AS miss, sum(greatest(e - r, 0)) AS fa FROM f GROUP BY pair)
    SELECT pair, round(CASE WHEN e > 0 THEN tp / e ELSE 'NaN' END, 6) AS precision, round(CASE WHEN r > 0 THEN tp / r ELSE 'NaN' END, 6) AS recall, round(CASE WHEN e + r - tp > 0 THEN tp / (e + r - tp) ELSE 'NaN' END, 6) AS accuracy,
      round(CASE WHEN r > 0 THEN miss / r ELSE 'NaN' END, 6) AS miss_error, round(CASE WHEN r > 0 THEN fa / r ELSE 'NaN' END, 6) AS false_alarm_error FROM k""",
)
def e19(spark, sf):
    s = S.multipitch_scores(pairs(spark, sf), ["pair"], "real", "gen", 0.1)
    return rounded(s, *s.columns[1:])


#: Peaks of a curve, merged by the running mean of a group.
PEAKS = """{n}_p AS (SELECT clip_id, list(frame::DOUBLE ORDER BY frame) AS p FROM (SELECT clip_id, frame, v, max(v) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM (SELECT clip_id, frame, {v} AS v FROM grid)) WHERE v = top AND v > 0.5 GROUP BY clip_id),
{n}_w AS (SELECT clip_id, p, 1 AS i, NULL::DOUBLE AS mean, 0 AS n, []::DOUBLE[] AS done FROM {n}_p UNION ALL
  SELECT clip_id, p, i + 1, CASE WHEN p[i] - mean <= 1 THEN (mean * n + p[i]) / (n + 1) ELSE p[i] END, CASE WHEN p[i] - mean <= 1 THEN n + 1 ELSE 1 END, CASE WHEN mean IS NULL OR p[i] - mean <= 1 THEN done ELSE list_append(done, mean) END
  FROM {n}_w WHERE i <= len(p)),
{n} AS (SELECT clip_id, list_transform(list_append(done, mean), lambda x: x / 10.0) AS t FROM {n}_w WHERE i = len(p) + 1)"""
GRID = "grid AS (SELECT clip_id, frame, coalesce(target, 0) / 100 AS target, coalesce(generated, 0) / 100 AS generated FROM (SELECT clip_id, unnest(range(31)) AS frame FROM (SELECT DISTINCT clip_id FROM fx_curves)) LEFT JOIN fx_curves USING (clip_id, frame))"
DOWN = "CASE WHEN frame % 3 = 0 THEN {c} ELSE 0 END"
_SNAP = "list_sort(list_distinct(list_transform(coalesce({d}.t, []), lambda d: CASE WHEN {b}.t IS NULL THEN d ELSE {b}.t[list_position(list_transform({b}.t, lambda b: abs(b - d)), list_min(list_transform({b}.t, lambda b: abs(b - d))))] END)))"
BEATS = ", ".join([GRID, *[PEAKS.format(n=n, v=v) for n, v in (("rb", "target"), ("eb", "generated"), ("rd", DOWN.format(c="target")), ("ed", DOWN.format(c="generated")))]]) + f""",
bt AS (SELECT clip_id, coalesce(rb.t, []) AS r, coalesce(eb.t, []) AS e, {_SNAP.format(d='rd', b='rb')} AS rd, {_SNAP.format(d='ed', b='eb')} AS ed FROM (SELECT DISTINCT clip_id FROM grid) LEFT JOIN rb USING (clip_id) LEFT JOIN eb USING (clip_id) LEFT JOIN rd USING (clip_id) LEFT JOIN ed USING (clip_id)),
bs AS (SELECT clip_id, 0 AS side, unnest(r) AS t FROM bt UNION ALL SELECT clip_id, 1, unnest(e) FROM bt), ds AS (SELECT clip_id, 0 AS side, unnest(rd) AS t FROM bt UNION ALL SELECT clip_id, 1, unnest(ed) FROM bt),
""" + MATCH.format(n="bm", k="clip_id", s="bs", tol=0.07) + ", " + MATCH.format(n="dm", k="clip_id", s="ds", tol=0.07)


def beats(spark, sf):
    """(clip_id, ref, est, ref_down, est_down) of the curves of clips; downbeats are peaks of each third frame."""
    c = R.zero_filled(view(spark, sf, "fx_curves"), "clip_id", 31, "target", "generated")
    both = None
    for name, v in (("ref", "target"), ("est", "generated")):
        d = c.select("clip_id", "frame", (F.col(v) / 100).alias("beat"), F.when(F.col("frame") % 3 == 0, F.col(v) / 100).otherwise(0.0).alias("down"))
        d = B.with_downbeats(d, "clip_id", "frame", "beat", "down", 10.0).withColumnsRenamed({"beats": name, "downs": f"{name}_down"})
        both = d if both is None else both.join(d, "clip_id")
    return both


@query("e20_beat_scores")
def e20(spark, sf):
    s = B.beat_scores(beats(spark, sf), ["clip_id"])
    return rounded(s, *s.columns[1:])


@query(
    "e20_beat_f",
    f"""WITH RECURSIVE {BEATS} SELECT clip_id, CASE WHEN len(r) = 0 THEN 'NaN' ELSE round(coalesce(2 * bm.m / (len(r) + len(e)), 0), 6) END::DOUBLE AS f_measure,
    CASE WHEN len(r) = 0 THEN 'NaN' WHEN len(e) = 0 THEN 0 ELSE round(list_sum(list_transform(r, lambda x: exp(-pow(list_min(list_transform(e, lambda y: abs(y - x))), 2) / (2 * 0.04 * 0.04)))) / (0.5 * (len(r) + len(e))), 6) END::DOUBLE AS cemgil,
    CASE WHEN len(rd) = 0 THEN 'NaN' ELSE round(coalesce(2 * dm.m / (len(rd) + len(ed)), 0), 6) END::DOUBLE AS downbeat_f_measure FROM bt LEFT JOIN bm USING (clip_id) LEFT JOIN dm USING (clip_id)""",
)
def e20_f(spark, sf):
    return rounded(B.beat_scores(beats(spark, sf), ["clip_id"]).select("clip_id", "f_measure", "cemgil", "downbeat_f_measure"), "f_measure", "cemgil", "downbeat_f_measure")


def scores(spark, sf):
    return view(spark, sf, "fx_scores").select("arm", F.col("metric_key").alias("cond"), F.lit("level").alias("metric"), "sample_id", F.col("score").alias("value"))


@query(
    "e22_score_ledger",
    """SELECT arm, metric_key AS cond, 'level' AS metric, count(*) FILTER (NOT isnan(score)) AS valid, count(DISTINCT sample_id) AS attempted, count(*) FILTER (isnan(score)) AS non_finite, 0 AS extract_errors FROM fx_scores GROUP BY ALL
    UNION ALL SELECT 'cond', 'broken', '<no metric>', 0, count(DISTINCT sample_id), 0, count(DISTINCT sample_id) FROM fx_scores WHERE arm = 'cond' AND sample_id % 5 = 0""",
)
def e22(spark, sf):
    s = scores(spark, sf)
    failed = s.where("arm = 'cond' and sample_id % 5 = 0").select("arm", F.lit("broken").alias("cond"), "sample_id").distinct()
    return S.coverage(S.ledger(s, failed))
