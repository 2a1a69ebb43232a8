"""Cleaning of frame series in rows (key, order, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_array(rows: DataFrame, key: str | list[str], order: str, value: str) -> DataFrame:
    """(key, a): the values of each series in order. A series is one chunk: a bounded number of frames."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("a"))


def zero_filled(rows: DataFrame, key: str, frames: int, *values: str) -> DataFrame:
    """Every frame 0..frames-1 of each key; missing ones hold zeros."""
    grid = rows.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))
    return grid.join(rows, [key, "frame"], "left").select(key, "frame", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def median_smooth(rows: DataFrame, key: str, order: str, value: str, win: int) -> DataFrame:
    """Median of an odd window with zeros beyond the ends; windows under 3 change nothing."""
    win += 1 - win % 2
    if win < 3:
        return rows
    h = win // 2
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-h, h)
    seen = F.collect_list(value).over(w)
    padded = F.concat(seen, F.array_repeat(F.lit(0.0), F.lit(win) - F.size(seen)))
    return rows.withColumn(value, F.get(F.array_sort(padded), F.lit(h)))


def moving_energy_mask(rows: DataFrame, key: str, order: str, value: str, win: int, hop: int, threshold_db: float) -> DataFrame:
    """(key, frame, silent): the moving mean of squares every ``hop`` samples, against a level."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(win // 2), (win - 1) // 2)
    mean = F.sum(F.col(value) * F.col(value)).over(w) / win
    db = 20 * F.log10(F.sqrt(mean + 1e-12) + 1e-9)
    return rows.withColumn("_db", db).where(F.col(order) % hop == 0).select(key, F.floor(F.col(order) / hop).alias("frame"), (F.col("_db") < threshold_db).alias("silent"))


def islands(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Adds ``island``: rows in a row with the same flag share it."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = rows.withColumn("_f", flag)
    return d.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "_f").orderBy(order))).drop("_f")


def drop_short_runs(rows: DataFrame, key: str, order: str, mask: str, min_len: int) -> DataFrame:
    """``mask`` without its true runs of fewer than ``min_len`` rows."""
    d = islands(rows, [key], order, F.col(mask))
    size = F.count("*").over(Window.partitionBy(key, mask, "island"))
    return d.withColumn(mask, F.col(mask) & (size >= min_len)).drop("island")


def peak_mask(rows: DataFrame, key: str, order: str, value: str, half: int, least: float = 0.5) -> DataFrame:
    """Adds ``peak``: the largest within +-half frames, and over ``least``."""
    top = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-half, half))
    return rows.withColumn("peak", (F.col(value) == top) & (F.col(value) > least))


def peak_times(rows: DataFrame, key: str, order: str, value: str, fps: float) -> DataFrame:
    """(key, times): peaks in seconds; a peak at most a frame after the running mean of a group joins it."""
    half = max(1, round(3 * fps / 50))
    at = as_array(peak_mask(rows, key, order, value, half).where("peak").withColumn("at", F.col(order).cast("double")), key, order, "at")
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(None).cast("double").alias("mean"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        joins = s["mean"].isNotNull() & (x - s["mean"] <= 1)
        grown = F.struct(s["done"].alias("done"), ((s["mean"] * s["n"] + x) / (s["n"] + 1)).alias("mean"), (s["n"] + 1).alias("n"))
        done = F.when(s["mean"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["mean"])))
        return F.when(joins, grown).otherwise(F.struct(done.alias("done"), x.alias("mean"), F.lit(1).alias("n")))

    end = lambda s: F.transform(F.when(s["mean"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["mean"]))), lambda x: x / fps)
    return at.select(key, F.aggregate("a", start, step, end).alias("times"))


def silence_to_zero(rows: DataFrame, value: str, rms: str, threshold_db: float) -> DataFrame:
    """Zero where the level is under the threshold."""
    return rows.withColumn(value, F.when(20 * F.log10(F.col(rms) + 1e-9) < threshold_db, 0.0).otherwise(F.col(value)))
