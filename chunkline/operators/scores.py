"""Per-clip fidelity scores. NaN means measured but undefined; a missing row means not measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkline.functions.series import dot
from chunkline.operators.beats import tolerance_match
from chunkline.operators.notes import DRUM0, KEYS, ONSET0, drum_class, gaussian_spread


def nan() -> Column:
    return F.lit(float("nan"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0."""
    return F.when(b == 0, nan()).otherwise(a / F.when(b != 0, b))


def cosine_fidelity(frames: DataFrame, keys: list[str], target: str, generated: str) -> DataFrame:
    """(keys, score): mean cosine over frames whose norms have a product over 1e-8; NaN if there is none."""
    t, g = F.col(target), F.col(generated)
    den = F.sqrt(dot(t, t)) * F.sqrt(dot(g, g))
    cos = F.when(den > 1e-8, dot(t, g) / den)
    return frames.groupBy(*keys).agg(F.coalesce(F.avg(cos), nan()).alias("score"))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; NaN where the product of the spreads is 1e-8 or less."""
    vx, vy = F.greatest(sxx - sx * sx / n, F.lit(0.0)), F.greatest(syy - sy * sy / n, F.lit(0.0))
    den = F.sqrt(vx) * F.sqrt(vy)
    return F.when(den > 1e-8, (sxy - sx * sy / n) / den).otherwise(nan())


def pearson_fidelity(frames: DataFrame, keys: list[str], target: str, generated: str, voiced_only: bool = False) -> DataFrame:
    """(keys, score); with ``voiced_only`` over frames with a target above 0, of which two are needed."""
    rows = frames.withColumn("_x", F.col(target).cast("double")).withColumn("_y", F.col(generated).cast("double"))
    use = (F.col("_x") > 0) if voiced_only else F.lit(True)
    s = lambda c: F.sum(F.when(use, c))
    x, y = F.col("_x"), F.col("_y")
    sums = rows.groupBy(*keys).agg(F.count(F.when(use, 1)).alias("n"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"))
    score = pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return sums.select(*keys, F.when(F.col("n") >= (2 if voiced_only else 1), score).otherwise(nan()).alias("score"))


#: Clips whose rolls a task compares.
CLIPS_PER_TASK = 500


def two_rolls(target: DataFrame, generated: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, slot, t, g): the lit cells of both rolls under each other, ``t`` or ``g`` 1."""
    side = lambda d, t, g: d.select(*keys, "frame", "slot", F.lit(t).alias("t"), F.lit(g).alias("g"))
    return side(target, 1, 0).unionByName(side(generated, 0, 1))


def onset_correlation(both: DataFrame, keys: list[str], slots: int, frames: int, sigma: float = 2.0) -> DataFrame:
    """(keys, score) of lit cells of two rolls smoothed along time, over all slots and frames. Keys without target cells are not returned."""
    s = lambda c: F.sum(c)
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    cells = gaussian_spread(both, sigma, frames).groupBy(*keys, "slot", "frame").agg(s(w * F.col("t")).alias("x"), s(w * F.col("g")).alias("y"))
    sums = cells.groupBy(*keys).agg(s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"))
    r = pearson(F.lit(slots * frames), *[F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])
    return sums.where("sx > 0").select(*keys, F.when(F.col("sy") == 0, 0.0).otherwise(r).alias("score"))


def roll_fidelity(target: DataFrame, generated: DataFrame, clips: DataFrame, keys: list[str], frames: int) -> DataFrame:
    """(keys, cosine, onset_corr, drum_corr) of two rolls of lit cells, for every row of ``clips`` (keys).

    The rolls of a clip are dealt to one task before they are spread, ``CLIPS_PER_TASK`` clips to each, so that spread cells are
    not shuffled and no task grows with the table.
    """
    slot, clips = F.col("slot"), clips.select(*keys).distinct()
    tasks = max(1, -(-clips.count() // CLIPS_PER_TASK))
    part = lambda lo, hi: two_rolls(*(d.where(slot.between(lo, hi - 1)) for d in (target, generated)), keys).repartition(tasks, *keys)
    cells = part(0, KEYS).groupBy(*keys, "frame", "slot").agg(F.max("t").alias("t"), F.max("g").alias("g"))
    per = cells.groupBy(*keys, "frame").agg(F.sum("t").alias("nt"), F.sum("g").alias("ng"), F.sum(F.col("t") * F.col("g")).alias("both"))
    cos = F.when((F.col("nt") > 0) & (F.col("ng") > 0), F.col("both") / F.sqrt(F.col("nt") * F.col("ng"))).otherwise(0.0)
    out = clips.join(per.groupBy(*keys).agg(F.avg(cos).alias("cosine")), keys, "left")
    for name, lo, hi in (("onset_corr", ONSET0, DRUM0), ("drum_corr", DRUM0, DRUM0 + 9)):
        out = out.join(onset_correlation(part(lo, hi), keys, hi - lo, frames).withColumnRenamed("score", name), keys, "left")
    return out.select(*keys, *[F.coalesce(c, nan()).alias(c) for c in ("cosine", "onset_corr", "drum_corr")])


def melody_scores(frames: DataFrame, keys: list[str], ref: str, est: str) -> DataFrame:
    """Pitch and voicing scores of frames in Hz, 0 unvoiced; hits are within 50 cents."""
    r, e = F.col(ref), F.col(est)
    diff = 1200 * (F.log2(F.when(e > 0, e)) - F.log2(F.when(r > 0, r)))
    chroma = diff - 1200 * F.floor(diff / 1200 + 0.5)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = frames.groupBy(*keys).agg(
        F.count("*").alias("n"), count(r > 0).alias("v"), count((r > 0) & (e > 0)).alias("vv"), count((r <= 0) & (e > 0)).alias("fa"),
        count((r <= 0) & (e <= 0)).alias("uu"), count(F.abs(diff) < 50).alias("hit"), count(F.abs(chroma) < 50).alias("chit"),
    )
    c = F.col
    return per.select(
        *keys, ratio(c("hit"), c("v")).alias("raw_pitch_accuracy"), ratio(c("chit"), c("v")).alias("raw_chroma_accuracy"), ratio(c("vv"), c("v")).alias("voicing_recall"),
        ratio(c("fa"), c("n") - c("v")).alias("voicing_false_alarm"), ((c("hit") + c("uu")) / c("n")).alias("overall_accuracy"),
    )


def multipitch_scores(frames: DataFrame, keys: list[str], target: str, generated: str, threshold: float = 0.5, classes: int = 12) -> DataFrame:
    """Scores of the classes that are on in each frame."""
    on = lambda c: F.transform(F.slice(c, 1, classes), lambda x: x >= threshold)
    size = lambda c: F.size(F.filter(c, lambda x: x))
    d = frames.withColumn("_t", on(target)).withColumn("_g", on(generated))
    d = d.withColumn("tp", size(F.zip_with("_t", "_g", lambda a, b: a & b))).withColumn("ref", size(F.col("_t"))).withColumn("est", size(F.col("_g")))
    pos = lambda c: F.greatest(c, F.lit(0))
    per = d.groupBy(*keys).agg(
        F.sum("tp").alias("tp"), F.sum("ref").alias("ref"), F.sum("est").alias("est"), F.sum(pos(F.col("ref") - F.col("est"))).alias("miss"), F.sum(pos(F.col("est") - F.col("ref"))).alias("fa")
    )
    c = F.col
    return per.select(
        *keys, ratio(c("tp"), c("est")).alias("precision"), ratio(c("tp"), c("ref")).alias("recall"), ratio(c("tp"), c("est") + c("ref") - c("tp")).alias("accuracy"),
        ratio(c("miss"), c("ref")).alias("miss_error"), ratio(c("fa"), c("ref")).alias("false_alarm_error"),
    )


def match_scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, precision, recall, f1) from (n_ref, n_est, n_match). Both sides empty: all NaN; no estimate: (NaN, 0, 0); no reference: (0, NaN, NaN)."""
    r, e, m = F.col("n_ref"), F.col("n_est"), F.col("n_match")
    f1 = F.when(m > 0, 2 * m / (r + e)).otherwise(0.0)
    return counts.select(*keys, ratio(m, e).alias("precision"), ratio(m, r).alias("recall"), F.when(r == 0, nan()).otherwise(f1).alias("f1"))


def transcription_scores(ref: DataFrame, est: DataFrame, clips: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """(keys, note_precision, note_recall, note_f1, drum_precision, drum_recall, drum_f1) for every row of ``clips`` (keys).

    Events (keys, onset, pitch, is_drum) match one to one by pitch, drums by their class; drums of no class are left out.
    """
    def slotted(d: DataFrame) -> DataFrame:
        d = d.withColumn("slot", F.when(F.col("is_drum"), drum_class(F.col("pitch"))).otherwise(F.col("pitch")))
        return d.where("slot is not null").select(*keys, "is_drum", "slot", "onset")

    counts = tolerance_match(slotted(ref), slotted(est), [*keys, "is_drum"], "slot", "onset", tolerance)
    out = clips.select(*keys).distinct()
    for name, drum in (("note", False), ("drum", True)):
        s = match_scores(counts.where(F.col("is_drum") == drum), keys)
        out = out.join(s.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")]), keys, "left")
    return out.select(*keys, *[F.coalesce(c, nan()).alias(c) for c in out.columns if c not in keys])


def ledger(scores: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Long scores (arm, cond, metric, sample_id, value) with a status: ok or non_finite; failures (arm, cond, sample_id) as extract_error."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    out = scores.select("arm", "cond", "metric", "sample_id", "value", F.when(finite, "ok").otherwise("non_finite").alias("status"))
    if failures is not None:
        out = out.unionByName(failures.select("arm", "cond", F.lit(None).cast("string").alias("metric"), "sample_id", F.lit(None).cast("double").alias("value"), F.lit("extract_error").alias("status")))
    return out


def coverage(rows: DataFrame) -> DataFrame:
    """(arm, cond, metric, valid, attempted, non_finite, extract_errors); a condition that only failed has metric ``<no metric>``."""
    per_cond = rows.groupBy("arm", "cond").agg(F.countDistinct("sample_id").alias("attempted"), F.count(F.when(F.col("status") == "extract_error", 1)).alias("extract_errors"))
    per_key = rows.where("metric is not null").groupBy("arm", "cond", "metric").agg(F.count(F.when(F.col("status") == "ok", 1)).alias("valid"), F.count(F.when(F.col("status") == "non_finite", 1)).alias("non_finite"))
    return per_cond.join(per_key, ["arm", "cond"], "left").select("arm", "cond", F.coalesce("metric", F.lit("<no metric>")).alias("metric"), F.coalesce("valid", F.lit(0)).alias("valid"), "attempted", F.coalesce("non_finite", F.lit(0)).alias("non_finite"), "extract_errors")
