"""Validity of latents, channel statistics, moments and distances between Gaussians."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chunkline.sources.storage import staged

PART = pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("dev", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64())), ("first", pa.list_(pa.struct([("key", pa.string()), ("status", pa.string())])))])
MOMENTS = "n long, sx array<double>, sxx array<double>"


def not_finite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def latent_status(frames: DataFrame, key: str, value: str, dims: int, count: int | Column) -> DataFrame:
    """(key, status) of chunks of frames: ok, unreadable (a null frame), bad_shape, short or non_finite.

    ``count`` is how many frames a chunk has to have: one number, or a column with each chunk's own.
    """
    v = F.col(value)
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0)) > 0
    per = frames.groupBy(key).agg(
        F.count("*").alias("n"), F.max(F.lit(count)).alias("wanted"), bad(v.isNull()).alias("unreadable"), bad(v.isNotNull() & (F.size(v) != dims)).alias("shape"), bad(F.coalesce(F.exists(v, not_finite), F.lit(False))).alias("nan")
    )
    status = F.when(F.col("unreadable"), "unreadable").when(F.col("shape"), "bad_shape").when(F.col("n") < F.col("wanted"), "short").when(F.col("nan"), "non_finite").otherwise("ok")
    return per.select(key, status.alias("status"))


def channel_stats(dims: DataFrame, channel: str = "d", value: str = "v", eps: float = 1e-6) -> DataFrame:
    """(d, n, mean, std) over long rows: population variance in double, std = sqrt(var + eps)."""
    x = F.col(value).cast("double")
    return dims.groupBy(channel).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.sqrt(F.var_pop(x) + eps).alias("std"))


STATUSES = ("ok", "unreadable", "bad_shape", "short", "non_finite")
#: Rejected clips that a report names.
NAMED = 10


def valid_channel_stats(frames: DataFrame, key: str, order: str, value: str, dims: int, count: int, eps: float = 1e-6) -> tuple[DataFrame, dict]:
    """((d, n, mean, std) over the frames of valid clips, {counts: {status: n}, first: [(key, status)]}).

    One pass: a task sums up the valid clips it has (count, mean and squared deviations of each channel), counts all by
    status and keeps the first NAMED rejected ones by key; the counts are metrics of that same pass. Stops if
    there is no valid clip, or if a channel's statistics are not finite. A clip is one row meanwhile.
    """
    v = F.col(value)
    clips = frames.select(F.col(key).cast("string").alias("key"), F.col(order).alias("at"), v.cast("array<double>").alias("v")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("f"))
    vs = F.transform("f", lambda x: x["v"])
    status = (
        F.when(F.exists("vs", lambda x: x.isNull()), "unreadable").when(F.exists("vs", lambda x: F.size(x) != dims), "bad_shape").when(F.size("vs") < count, "short")
        .when(F.exists("vs", lambda x: F.exists(x, not_finite)), "non_finite").otherwise("ok")
    )
    clips = clips.select("key", vs.alias("vs")).select("key", status.alias("status"), F.flatten("vs").alias("x"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, dev = 0, np.zeros(dims), np.zeros(dims)
        counts, first = dict.fromkeys(STATUSES, 0), []
        for b in batches:
            for k, s, x in zip(b.column("key").to_pylist(), b.column("status").to_pylist(), b.column("x"), strict=True):
                counts[s] += 1
                if s != "ok":
                    first = sorted([*first, (k, s)], key=lambda r: (r[0] is not None, r[0]))[:NAMED]
                    continue
                x = x.values.to_numpy().reshape(-1, dims)
                m, here = len(x), x.mean(0)
                # two sets of deviations meet by the distance of their means
                dev += ((x - here) ** 2).sum(0) + (here - mean) ** 2 * (n * m / (n + m))
                mean += (here - mean) * (m / (n + m))
                n += m
        if sum(counts.values()):
            yield pa.RecordBatch.from_pylist([{"n": n, "mean": mean.tolist(), "dev": dev.tolist(), "counts": list(counts.values()), "first": [{"key": k, "status": s} for k, s in first]}], schema=PART)

    parts = clips.mapInArrow(add, "n long, mean array<double>, dev array<double>, counts array<long>, first array<struct<key: string, status: string>>")
    seen = Observation("clips")
    totals = [F.sum(F.get("counts", F.lit(i))).alias(s) for i, s in enumerate(STATUSES)]
    first = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, NAMED).alias("first")
    parts = staged(parts.observe(seen, *totals, first), "channel-parts")
    report = {"counts": {s: seen.get[s] or 0 for s in STATUSES}, "first": [(r["key"], r["status"]) for r in seen.get["first"] or []]}
    if not report["counts"]["ok"]:
        raise ValueError(f"no valid clip: {report['counts']}, first {report['first']}")
    # a row for each task and channel
    rows = parts.where("n > 0").select("n", F.posexplode(F.arrays_zip("mean", "dev")).alias("d", "c"))
    met = rows.groupBy("d").agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), "c.mean", "c.dev")).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, r: s + r["n"])
    met = met.withColumn("n", total).withColumn("mean", F.aggregate("p", F.lit(0.0), lambda s, r: s + r["n"] * r["mean"]) / F.col("n"))
    dev = F.aggregate("p", F.lit(0.0), lambda s, r: s + r["dev"] + r["n"] * (r["mean"] - F.col("mean")) * (r["mean"] - F.col("mean")))
    stats = met.select("d", F.col("n").cast("long").alias("n"), "mean", F.sqrt(dev / F.col("n") + eps).alias("std"))
    return require_sound_stats(stats), report


def stats_status(mean: Column, std: Column) -> Column:
    """non_finite (or missing), flat (a std of 0 or less) or ok."""
    lost = mean.isNull() | std.isNull() | not_finite(mean) | not_finite(std)
    return F.when(lost, "non_finite").when(std <= 0, "flat").otherwise("ok")


def require_sound_stats(stats: DataFrame) -> DataFrame:
    """Stops if there are no channels, or one has a mean or std that is not finite, or a std of 0 or less."""
    r = stats.agg(F.count("*").alias("n"), F.count(F.when(stats_status(F.col("mean"), F.col("std")) != "ok", 1)).alias("bad")).first()
    if not r["n"] or r["bad"]:
        raise ValueError(f"{r['bad']} of {r['n']} channels have unusable statistics")
    return stats


def normalize(dims: DataFrame, stats: DataFrame, value: str = "v", inverse: bool = False) -> DataFrame:
    """(v - mean) / std by channel, or back. The statistics have a row for each channel: a bounded table."""
    joined = dims.join(F.broadcast(stats.select("d", "mean", "std")), "d")
    c = F.col(value) * F.col("std") + F.col("mean") if inverse else (F.col(value) - F.col("mean")) / F.col("std")
    return joined.withColumn(value, c).drop("mean", "std")


def partial_moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, sx, sxx): one row for each key and task, summed in double."""
    kind = rows.schema[key].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for k, vs in b.groupby(key, dropna=False)[value]:
                x = np.stack([np.asarray(v, np.float64) for v in vs])
                n, sx, sxx = total.get(k, (0, 0.0, 0.0))
                total[k] = (n + len(x), sx + x.sum(0), sxx + x.T @ x)
        for k, (n, sx, sxx) in total.items():
            yield pd.DataFrame({key: [k], "n": [n], "sx": [sx], "sxx": [np.asarray(sxx).ravel()]})

    return rows.where(F.col(value).isNotNull()).select(key, value).mapInPandas(add, f"{key} {kind}, {MOMENTS}")


def merge_moments(parts: DataFrame, key: str) -> DataFrame:
    """Sums of moment rows by key, place by place."""
    n = parts.groupBy(key).agg(F.sum("n").alias("n"))
    total = lambda c: parts.select(key, F.posexplode(c).alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias(c))
    return n.join(total("sx"), key).join(total("sxx"), key)


def moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    return merge_moments(partial_moments(rows, key, value), key)


def covariances(mom: DataFrame, key: str) -> DataFrame:
    """(key, i, j, cov) from moments of two rows or more."""
    d = F.size("sx")
    rows = mom.where("n >= 2").select(key, "n", "sx", d.alias("d"), F.posexplode("sxx").alias("p", "x"))
    i, j = F.floor(F.col("p") / F.col("d")).cast("int"), (F.col("p") % F.col("d")).cast("int")
    return rows.select(key, i.alias("i"), j.alias("j"), ((F.col("x") - F.get("sx", i) * F.get("sx", j) / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def gaussian(n: int, sx: np.ndarray, sxx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mu = np.asarray(sx, float) / n
    return mu, (np.asarray(sxx, float).reshape(len(mu), -1) - np.outer(sx, mu)) / (n - 1)


def _root(m: np.ndarray, eps: float) -> np.ndarray:
    w, v = np.linalg.eigh((m + m.T) / 2)
    return (v * np.sqrt(np.maximum(w, eps))) @ v.T


def frechet(mu1: np.ndarray, s1: np.ndarray, mu2: np.ndarray, s2: np.ndarray, eps: float = 1e-6) -> float:
    """Squared distance of the means plus that of the covariances, both with ``eps`` on the diagonal."""
    e = eps * np.eye(len(mu1))
    s1, s2 = s1 + e, s2 + e
    r = _root(s1, eps)
    w = np.linalg.eigvalsh(r @ ((s2 + s2.T) / 2) @ r)
    return float(((mu1 - mu2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.maximum(w, eps)).sum())


def gaussian_kl(mu1: np.ndarray, s1: np.ndarray, mu2: np.ndarray, s2: np.ndarray, eps: float = 1e-6) -> float:
    """KL of the first from the second, full covariances."""
    e = eps * np.eye(len(mu1))
    c1, c2 = (np.linalg.cholesky((s + s.T) / 2 + e) for s in (s1, s2))
    a, b = np.linalg.solve(c2, c1), np.linalg.solve(c2, mu2 - mu1)
    return float(0.5 * ((a**2).sum() + (b**2).sum() - len(mu1)) + np.log(np.diag(c2)).sum() - np.log(np.diag(c1)).sum())


def distribution_distances(mom: DataFrame, key: str, group: str, real: str = "real") -> DataFrame:
    """(group, fd, kl_real_gen, kl_gen_real) from one moment row each of ``key`` = real and another, for each group.

    The moments of a group are two rows; the D x D algebra runs in one task for each group.
    """
    kind = mom.schema[group].dataType.simpleString()

    def tail(pdf: pd.DataFrame) -> pd.DataFrame:
        of = {r[key] == real: gaussian(r["n"], np.asarray(r["sx"]), np.asarray(r["sxx"])) for _, r in pdf[pdf["n"] >= 2].iterrows()}
        if len(of) < 2:
            return pd.DataFrame({group: pdf[group].iloc[:1], "fd": [np.nan], "kl_real_gen": [np.nan], "kl_gen_real": [np.nan]})
        a, b = of[True], of[False]
        return pd.DataFrame({group: pdf[group].iloc[:1].to_numpy(), "fd": [frechet(*a, *b)], "kl_real_gen": [gaussian_kl(*a, *b)], "kl_gen_real": [gaussian_kl(*b, *a)]})

    return mom.groupBy(group).applyInPandas(tail, f"{group} {kind}, fd double, kl_real_gen double, kl_gen_real double")
