"""Notes to frames and back, pairing of messages, nearest events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lowest key and number of keys; drum pitches by class.
LOWEST, KEYS = 21, 88
DRUMS = (
    (36, 35),
    (38, 27, 28, 31, 32, 33, 34, 37, 39, 40, 56, 65, 66, 75, 85),
    (42, 44, 54, 68, 69, 70, 71, 73, 78, 80, 22),
    (46, 67, 72, 74, 79, 81, 26),
    (45, 29, 41, 43, 61, 64, 84),
    (48, 47, 60, 63, 77, 86, 87),
    (50, 30, 62, 76, 83),
    (49, 52, 55, 57, 58),
    (51, 53, 59, 82),
)
ONSET0, DRUM0 = KEYS, 2 * KEYS
#: Notes that a task joins with windows.
NOTES_PER_TASK = 100_000


def drum_class(pitch: Column) -> Column:
    """Drum class of a pitch; null if it has none."""
    pairs = [F.lit(x) for k, ps in enumerate(DRUMS) for p in ps for x in (p, k)]
    return F.element_at(F.create_map(*pairs), pitch)


def notes_in_windows(notes: DataFrame, windows: DataFrame, key: str, length: float) -> DataFrame:
    """Notes (key, onset, offset, ...) with every window (key, t0) they sound in; times become relative.

    Windows start at multiples of ``length`` apart (in any offset): both sides are dealt by the number of
    the length they touch, so the join stays an equi-join for long sources. Tasks are as many as the notes ask for
    (``NOTES_PER_TASK``), so that none grows with the table.
    """
    at = lambda c: F.floor(c / length)
    tasks = max(1, -(-notes.count() // NOTES_PER_TASK))
    touched = notes.withColumn("_b", F.explode(F.sequence(at(F.col("onset")), F.greatest(at(F.col("offset")), at(F.col("onset"))))))
    spans = windows.withColumn("_b", F.explode(F.sequence(at(F.col("t0")), at(F.col("t0") + length))))
    touched, spans = (d.repartition(tasks, key, "_b") for d in (touched, spans))
    met = touched.join(spans, [key, "_b"]).where((F.col("offset") - F.col("t0") > 0) & (F.col("onset") - F.col("t0") < length))
    # a pair meets in one bucket only: the first that both touch
    met = met.where(F.col("_b") == F.greatest(at(F.col("onset")), at(F.col("t0"))))
    return met.withColumn("onset", F.col("onset") - F.col("t0")).withColumn("offset", F.col("offset") - F.col("t0")).drop("_b")


def notes_to_cells(notes: DataFrame, keys: list[str], fps: float, frames: int) -> DataFrame:
    """(keys, frame, slot) of the lit cells: sounding keys, onsets, drum classes. Notes: (keys, onset, offset, pitch, is_drum)."""
    a = F.rint(F.col("onset") * fps).cast("long")
    lo, hi = F.greatest(a, F.lit(0)), F.least(F.greatest(F.rint(F.col("offset") * fps).cast("long"), a + 1), F.lit(frames))
    starts = (F.col("onset") >= 0) & (a < frames)
    key = F.col("pitch") - LOWEST
    cell = lambda frame, slot: F.struct(frame.cast("long").alias("frame"), slot.cast("int").alias("slot"))
    none = F.array().cast("array<struct<frame:bigint,slot:int>>")
    sounding = F.when(hi > lo, F.transform(F.sequence(lo, F.greatest(hi - 1, lo)), lambda f: cell(f, key))).otherwise(none)
    onset = F.when(starts, F.array(cell(a, key + ONSET0))).otherwise(none)
    drum = F.when(starts & drum_class(F.col("pitch")).isNotNull(), F.array(cell(a, drum_class(F.col("pitch")) + DRUM0))).otherwise(none)
    heard = notes.where((F.col("offset") > 0) & (F.col("onset") < frames / fps))
    lit = F.when(F.col("is_drum"), drum).when(key.between(0, KEYS - 1), F.concat(sounding, onset)).otherwise(none)
    return heard.select(*keys, F.inline(lit)).distinct()


def cells_to_notes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pitch, start, stop) in frames: a note starts at an onset and goes on until silence or the next onset."""
    slot = F.col("slot")
    lit = cells.where(slot < DRUM0).groupBy(*keys, (slot % KEYS).alias("key"), "frame").agg(F.bool_or(slot < KEYS).alias("sounds"), F.bool_or(slot >= ONSET0).alias("starts"))
    w = Window.partitionBy(*keys, "key").orderBy("frame")
    gap = F.coalesce(F.col("frame") - F.lag("frame").over(w) > 1, F.lit(True))
    # a run ends at a gap, at an onset, and where nothing sounds; only runs that begin with an onset are notes
    cut = F.col("starts") | gap | ~F.col("sounds")
    runs = lit.withColumn("run", F.sum(cut.cast("int")).over(w))
    per = runs.groupBy(*keys, "key", "run").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"), F.bool_or("starts").alias("is_note"))
    return per.where("is_note").select(*keys, (F.col("key") + LOWEST).alias("pitch"), "start", "stop")


def pair_on_off(messages: DataFrame, keys: list[str], order: list[str], time: str, kind: str = "kind") -> DataFrame:
    """(keys, note, start, stop): the oldest open on is closed by an off; an off with none open is passed over.

    Notes left open end with the last message of ``keys``. An off is stray where the running balance of ons
    and offs reaches a new minimum below zero.
    """
    w = Window.partitionBy(*keys, "note").orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    m = messages.withColumn("bal", F.sum(F.when(F.col(kind) == "on", 1).otherwise(-1)).over(up_to))
    m = m.withColumn("low", F.least(F.coalesce(F.min("bal").over(before), F.lit(0)), F.lit(0)))
    m = m.where((F.col(kind) == "on") | (F.col("bal") >= F.col("low")))
    m = m.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "note", kind).orderBy(*order)))
    last = messages.groupBy(*keys).agg(F.max(time).alias("last"))
    ons = m.where(F.col(kind) == "on").select(*keys, "note", "r", F.col(time).alias("start"))
    offs = m.where(F.col(kind) == "off").select(*keys, "note", "r", F.col(time).alias("off"))
    paired = ons.join(offs, [*keys, "note", "r"], "left").join(last, keys)
    return paired.select(*keys, "note", "start", F.coalesce("off", "last").alias("stop"))


def nearest_event(points: DataFrame, events: DataFrame, key: str, time: str) -> DataFrame:
    """(key, time, nearest): for each point the event nearest in time, the earlier of two as near."""
    e = events.select(key, time, F.col(time).alias("ev"), F.lit(0).alias("side"))
    p = points.select(key, time, F.lit(None).cast(events.schema[time].dataType).alias("ev"), F.lit(1).alias("side"))
    w = Window.partitionBy(key).orderBy(time, "side")
    back = F.last("ev", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("ev", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col(time).desc(), "side").rowsBetween(Window.unboundedPreceding, 0))
    d = e.unionByName(p).withColumn("b", back).withColumn("a", ahead).where("side = 1")
    near = F.when(F.col("a").isNull() | (F.col(time) - F.col("b") <= F.col("a") - F.col(time)), F.col("b")).otherwise(F.col("a"))
    return d.select(key, time, near.alias("nearest"))


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    import math

    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k, x / sum(w)) for k, x in zip(range(-r, r + 1), w, strict=True)]


def gaussian_spread(cells: DataFrame, sigma: float, frames: int) -> DataFrame:
    """The lit cells with a row, and its weight ``w``, for each frame that they reach; nothing comes from beyond the ends."""
    kernel = F.map_from_arrays(*[F.array(*[F.lit(x) for x in xs]) for xs in zip(*gaussian_kernel(sigma), strict=True)])
    rest = [c for c in cells.columns if c != "frame"]
    spread = cells.select(*rest, "frame", F.explode(kernel).alias("k", "w"))
    return spread.select(*rest, (F.col("frame") + F.col("k")).alias("frame"), "w").where(F.col("frame").between(0, frames - 1))


def gaussian_smooth(cells: DataFrame, keys: list[str], sigma: float, frames: int) -> DataFrame:
    """(keys, slot, frame, v): lit cells spread along time."""
    return gaussian_spread(cells.select(*keys, "slot", "frame"), sigma, frames).groupBy(*keys, "slot", "frame").agg(F.sum("w").alias("v"))
