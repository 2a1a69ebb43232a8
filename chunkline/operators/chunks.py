"""Cutting sources into fixed-length chunks, gates, numbering and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def window_starts(length: Column, size: int, overlap: int = 0, keep: int | None = None) -> Column:
    """Starts of the chunks of a source; with ``keep``, those at the middle of that many even bins."""
    hop = size - overlap
    n = F.floor((length - size) / hop) + 1
    every = F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda k: k * hop)
    if keep:
        mids = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda k: F.floor(n * (2 * k + 1) / (2 * keep)).cast("long") * hop)
        every = F.array_distinct(mids)
    return F.when(length >= size, every).otherwise(F.array().cast("array<bigint>"))


def mean_dbfs(x: Column) -> Column:
    return 20 * F.log10(F.avg(F.abs(x)) + 1e-7)


def source_gates(samples: DataFrame, key: str, *, min_len: int = 0, peak: float | None = None, max_peak_ratio: float = 1.0, silence: float | None = None, max_silence_ratio: float = 1.0) -> DataFrame:
    """Keys of the sources to keep, from (key, seq, x).

    Dropped: fewer than ``min_len`` samples; a share of |x| >= ``peak`` over ``max_peak_ratio``; a share of
    |x| < ``silence`` of ``max_silence_ratio`` or more (the first limit is kept, the second dropped).
    """
    share = lambda c: F.avg(c.cast("int"))
    per = samples.groupBy(key).agg(F.count("*").alias("n"), share(F.abs("x") >= (peak or 0)).alias("loud"), share(F.abs("x") < (silence or 0)).alias("quiet"))
    ok = F.col("n") >= min_len
    if peak is not None:
        ok &= F.col("loud") <= max_peak_ratio
    if silence is not None:
        ok &= F.col("quiet") < max_silence_ratio
    return per.where(ok).select(key)


def head_and_clip(samples: DataFrame, first: int, peak: float) -> DataFrame:
    """The first samples of each source, cut to +-peak."""
    return samples.where(F.col("seq") < first).withColumn("x", F.greatest(F.least("x", F.lit(peak)), F.lit(-peak)))


def cut_chunks(samples: DataFrame, key: str, size: int, overlap: int = 0) -> DataFrame:
    """(key, start, seq, x): each sample in every chunk that holds it. No range join: starts follow from the place."""
    hop = size - overlap
    lens = samples.groupBy(key).agg((F.max("seq") + 1).alias("length"))
    rows = samples.join(lens, key).where(F.col("length") >= size)
    last = F.floor((F.col("length") - size) / hop)
    lo = F.greatest(F.ceil((F.col("seq") - size + 1) / hop), F.lit(0))
    hi = F.least(F.floor(F.col("seq") / hop), last)
    rows = rows.where(lo <= hi).select(key, F.explode(F.sequence(lo, hi)).alias("k"), "seq", "x")
    return rows.select(key, (F.col("k") * hop).alias("start"), (F.col("seq") - F.col("k") * hop).alias("seq"), "x")


def chunk_levels(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.groupBy(key, "start").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"), mean_dbfs(F.col("x")).alias("dbfs"))


def energy_gate(rms: float | None = None, peak: float | None = None) -> Column:
    """No threshold keeps all; else one that is set must be passed."""
    if rms is None and peak is None:
        return F.lit(True)
    tests = [F.col(c) > t for c, t in (("rms", rms), ("peak", peak)) if t is not None]
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def numbered_chunks(levels: DataFrame, key: str, *, rms: float | None = None, peak: float | None = None, min_dbfs: float | None = None) -> DataFrame:
    """Chunks that pass the gates, numbered. A chunk that only fails the level in dBFS still uses up its number."""
    kept = levels.where(energy_gate(rms, peak))
    kept = kept.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1)
    return kept if min_dbfs is None else kept.where(F.col("dbfs") >= min_dbfs)


def padded_tail(samples: DataFrame, key: str, size: int, overlap: int = 0) -> DataFrame:
    """(key, start, seq, x) of the zero-padded chunk after the last whole one, where samples are left."""
    hop = size - overlap
    lens = samples.groupBy(key).agg((F.max("seq") + 1).cast("long").alias("length"))
    n = F.when(F.col("length") >= size, F.floor((F.col("length") - size) / hop) + 1).otherwise(0)
    tails = lens.withColumn("start", n * hop).where("start < length")
    rows = tails.select(key, "start", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("seq"))
    x = samples.select(F.col(key).alias("_k"), F.col("seq").alias("_s"), "x")
    return rows.join(x, (F.col(key) == F.col("_k")) & (F.col("start") + F.col("seq") == F.col("_s")), "left").select(key, "start", "seq", F.coalesce("x", F.lit(0.0)).alias("x"))


def clips_per_chunk(chunks: DataFrame, size: int) -> DataFrame:
    """(…, start) of the clips of ``size`` frames in chunks with ``frames``; shorter chunks give none."""
    k = F.floor(F.col("frames") / size)
    return chunks.where(k > 0).withColumn("start", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: i * size)))


def trim_points(regions: DataFrame, key: str, edge: float = 0.05) -> DataFrame:
    """(key, begin, stop) without the silence at either end. ``regions``: (key, duration, s, e), e null while open."""
    e = F.coalesce("e", "duration")
    per = regions.groupBy(key, "duration").agg(F.min_by(F.struct("s", e.alias("e")), "s").alias("first"), F.max_by(F.struct("s", e.alias("e")), "s").alias("last"))
    begin = F.when(F.col("first.s") < edge, F.col("first.e")).otherwise(0.0)
    stop = F.when(F.col("last.e") >= F.col("duration") - edge, F.col("last.s")).otherwise(F.col("duration"))
    return per.select(key, "duration", begin.alias("begin"), stop.alias("stop"))


def loudness_gain(target_lufs: float, target_tp: float, i: Column, tp: Column) -> Column:
    """The smaller of two gains, where both measurements are finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite(i) & finite(tp), F.least(F.lit(target_lufs) - i, F.lit(target_tp) - tp))
