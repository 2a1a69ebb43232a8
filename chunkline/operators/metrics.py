"""Which metric scores a condition: families by name, each a function from frames to long scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkline.operators import beats as B
from chunkline.operators import notes as N
from chunkline.operators import scores as S

#: A metric takes (frames, keys, target, generated) and gives (keys, one column a score). Rhythm and midi need ``frame``.
Metric = Callable[[DataFrame, list[str], str, str], DataFrame]


def _voiced_pearson(frames: DataFrame, keys: list[str], target: str, generated: str) -> DataFrame:
    return S.pearson_fidelity(frames, keys, target, generated, voiced_only=True)


#: Frames a second of the frames that are scored, and the value from which a slot of a roll is lit.
FPS, LIT = 50.0, 0.5


def _rhythm(frames: DataFrame, keys: list[str], target: str, generated: str) -> DataFrame:
    """Correlation of beat curves and of downbeat curves (places 0 and 1 of each frame)."""
    out = None
    for name, place in (("beat_corr", 0), ("downbeat_corr", 1)):
        d = frames.select(*keys, *[F.get(c, F.lit(place)).alias(n) for c, n in ((target, "t"), (generated, "g"))])
        s = S.pearson_fidelity(d, keys, "t", "g").withColumnRenamed("score", name)
        out = s if out is None else out.join(s, keys)
    return out


def _beats(frames: DataFrame, keys: list[str], target: str, generated: str, fps: float = FPS) -> DataFrame:
    """Beat measures of the peaks of both curves; ``frames`` has ``frame``, one key tells samples apart."""
    (key,) = keys
    out = None
    for name, c in (("ref", target), ("est", generated)):
        d = frames.select(key, "frame", F.get(c, F.lit(0)).alias("beat"), F.get(c, F.lit(1)).alias("down"))
        d = B.with_downbeats(d, key, "frame", "beat", "down", fps).withColumnsRenamed({"beats": name, "downs": f"{name}_down"})
        out = d if out is None else out.join(d, key)
    s = B.beat_scores(out, [key])
    return s.withColumnsRenamed({c: f"beat_{c}" for c in s.columns if c not in (key, "downbeat_f_measure")})


def _cells(frames: DataFrame, keys: list[str], roll: str) -> DataFrame:
    return frames.select(*keys, "frame", F.posexplode(roll).alias("slot", "v")).where(F.col("v") >= LIT).drop("v")


def _roll(frames: DataFrame, keys: list[str], target: str, generated: str) -> DataFrame:
    """Likeness of two rolls. All samples have as many frames as the longest."""
    n = frames.agg(F.max("frame") + 1).first()[0] or 1
    return S.roll_fidelity(_cells(frames, keys, target), _cells(frames, keys, generated), frames, keys, int(n))


def events_of(cells: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """(keys, onset, pitch, is_drum) in the cells of a roll; a drum has the first pitch of its class."""
    notes = N.cells_to_notes(cells, keys).select(*keys, (F.col("start") / fps).alias("onset"), F.col("pitch").cast("int").alias("pitch"), F.lit(False).alias("is_drum"))
    pitch = F.element_at(F.array(*[F.lit(p[0]) for p in N.DRUMS]), F.col("slot") - N.DRUM0 + 1)
    drums = cells.where(F.col("slot") >= N.DRUM0).select(*keys, (F.col("frame") / fps).alias("onset"), pitch.alias("pitch"), F.lit(True).alias("is_drum"))
    return notes.unionByName(drums)


def _transcription(frames: DataFrame, keys: list[str], target: str, generated: str, fps: float = FPS) -> DataFrame:
    ref, est = (events_of(_cells(frames, keys, c), keys, fps) for c in (target, generated))
    return S.transcription_scores(ref, est, frames, keys)


OWN: dict[str, Metric] = {"chroma": S.cosine_fidelity, "chord": S.cosine_fidelity, "energy": S.pearson_fidelity, "rhythm": _rhythm, "f0": _voiced_pearson, "midi": _roll}
MIR: dict[str, Metric] = {"f0": S.melody_scores, "chroma": S.multipitch_scores, "chord": S.multipitch_scores, "rhythm": _beats, "midi": _transcription}
FAMILIES: dict[str, dict[str, Metric]] = {"own": OWN, "mir": MIR}


#: Metrics that need the clock of the frames.
TIMED = (_beats, _transcription)


def metric_for(cond: str, family: str = "own") -> Metric:
    """The family's metric for a condition, else our own; an unknown condition stops."""
    found = FAMILIES[family].get(cond) or OWN.get(cond)
    if found is None:
        raise ValueError(f"no metric for {cond}; there are {sorted(OWN)}")
    return found


def evaluate(frames: dict[str, DataFrame], sample: str, target: str, generated: str, family: str = "own", fps: float = FPS) -> DataFrame:
    """(cond, metric, sample_id, value) of all conditions; a frame table each, of ``fps`` frames a second."""
    out = None
    for cond, df in frames.items():
        metric = metric_for(cond, family)
        wide = metric(df, [sample], target, generated, **({"fps": fps} if metric in TIMED else {}))
        names = [c for c in wide.columns if c != sample]
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")
        rows = wide.select(F.lit(cond).alias("cond"), F.col(sample).cast("long").alias("sample_id"), each).select("cond", "m.metric", "sample_id", "m.value")
        out = rows if out is None else out.unionByName(rows)
    return out
