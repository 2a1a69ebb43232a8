"""Matching of events and beat measures as folds over sorted arrays: two pointers, one step an event, no Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkline.operators.notes import nearest_event


def _walk(steps: Column, start: dict[str, Column], step: Callable[[Column], Column], end: Callable[[Column], Column]) -> Column:
    """``steps`` steps of a state of numbers."""
    each = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(each, _state(**start), lambda s, _: step(s), end)


def _state(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def match_count(ref: Column, est: Column, tolerance: float) -> Column:
    """Most one-to-one matches of two sorted arrays of times: with one tolerance on a line, the earliest match is the best."""

    def step(s: Column) -> Column:
        i, j, n = s["i"], s["j"], s["n"]
        d = F.round(F.get(est, j) - F.get(ref, i), 4)
        moved = lambda a, b, c: _state(i=i + a, j=j + b, n=n + c)
        return F.when(d.isNull(), s).when(F.abs(d) <= tolerance, moved(1, 1, 1)).when(d > 0, moved(1, 0, 0)).otherwise(moved(0, 1, 0))

    return _walk(F.size(ref) + F.size(est), {k: F.lit(0) for k in "ijn"}, step, lambda s: s["n"]).cast("long")


def tolerance_match(ref: DataFrame, est: DataFrame, keys: list[str], inner: str, time: str, tolerance: float) -> DataFrame:
    """(keys, n_ref, n_est, n_match) of events with the same ``inner`` key and times within the tolerance.

    Events of one inner key are parted where more than the tolerance lies between neighbours: no match goes over
    such a gap, so each part is matched alone, however many events a key has.
    """
    of = [*keys, inner]
    side = lambda d, n: d.select(*of, F.col(time).alias("t"), F.lit(n).alias("side"))
    order = Window.partitionBy(*of).orderBy("t")
    d = side(ref, 0).unionByName(side(est, 1))
    d = d.withColumn("new", F.coalesce(F.round(F.col("t") - F.lag("t").over(order), 4) > tolerance, F.lit(True)).cast("int"))
    d = d.withColumn("part", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    times = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("t"))))
    parts = d.groupBy(*of, "part").agg(times(0).alias("r"), times(1).alias("e"))
    parts = parts.select(*keys, F.size("r").alias("nr"), F.size("e").alias("ne"), match_count(F.col("r"), F.col("e"), tolerance).alias("m"))
    return parts.groupBy(*keys).agg(F.sum("nr").alias("n_ref"), F.sum("ne").alias("n_est"), F.sum("m").alias("n_match"))


def f_measure(ref: Column, est: Column, tolerance: float = 0.07) -> Column:
    both = F.size(ref) + F.size(est)
    return F.when(both > 0, 2 * match_count(ref, est, tolerance) / both).otherwise(0.0)


def cemgil(ref: Column, est: Column, sigma: float = 0.04) -> Column:
    """Sum over the reference of a Gaussian of the distance to the nearest estimate, over the mean number of beats."""

    def step(s: Column) -> Column:
        i, j, total = s["i"], s["j"], s["total"]
        here, near, after = F.get(ref, i), F.get(est, j), F.get(est, j + 1)
        nearer = F.coalesce(F.abs(after - here) <= F.abs(near - here), F.lit(False))
        gain = F.exp(-F.pow(here - near, F.lit(2.0)) / (2 * sigma**2))
        return F.when(here.isNull() | near.isNull(), s).when(nearer, _state(i=i, j=j + 1, total=total)).otherwise(_state(i=i + 1, j=j, total=total + gain))

    both = F.size(ref) + F.size(est)
    return _walk(both, {"i": F.lit(0), "j": F.lit(0), "total": F.lit(0.0)}, step, lambda s: s["total"]) / (0.5 * both)


def p_score(ref: Column, est: Column) -> Column:
    """Pairs within a fifth of the median period, on a clock of 100 a second, over the larger number of beats."""
    ticks = lambda a: F.transform(a, lambda t: F.rint(t * 100))
    r, e = ticks(ref), ticks(est)
    n = F.size(ref)
    gaps = F.array_sort(F.zip_with(F.slice(r, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(r, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a - b))
    middle = lambda k: F.get(gaps, F.floor(k).cast("int"))
    win = F.rint(0.2 * (middle((n - 2) / 2) + middle((n - 1) / 2)) / 2)

    def step(s: Column) -> Column:
        i, lo, hi, total = s["i"], s["lo"], s["hi"], s["total"]
        here = F.get(r, i)
        return (
            F.when(here.isNull(), s).when(F.get(e, hi) <= here + win, _state(i=i, lo=lo, hi=hi + 1, total=total))
            .when(F.get(e, lo) < here - win, _state(i=i, lo=lo + 1, hi=hi, total=total)).otherwise(_state(i=i + 1, lo=lo, hi=hi, total=total + hi - lo))
        )

    pairs = _walk(n + 2 * F.size(est), {k: F.lit(0) for k in ("i", "lo", "hi", "total")}, step, lambda s: s["total"])
    return F.least(pairs / F.greatest(n, F.size(est)), F.lit(1.0))


def continuity(ref: Column, est: Column, limit: float = 0.175) -> Column:
    """Share of estimated beats that keep the phase and period of the reference.

    The state has the place of the beat at hand, of the reference nearest to it and of the last one that was met: since both
    only move on, a reference beat is met again only if it is that last one.
    """

    def step(s: Column) -> Column:
        i, k, last, good = s["i"], s["k"], s["last"], s["good"]
        t, here, after = F.get(est, i), F.get(ref, k), F.get(ref, k + 1)
        first = (k == 0) | (i == 0)
        a, c = F.when(first, k).otherwise(k - 1), F.when(first, i).otherwise(i - 1)
        period = F.get(ref, a + 1) - F.get(ref, a)
        kept = (F.abs(t - here) / period < limit) & (F.abs(1 - (F.get(est, c + 1) - F.get(est, c)) / period) < limit)
        ok = F.coalesce((k != last) & kept, F.lit(False))
        seen = _state(i=i + 1, k=k, last=F.when(ok, k).otherwise(last), good=good + ok.cast("int"))
        return F.when(t.isNull(), s).when(F.abs(after - t) < F.abs(here - t), _state(i=i, k=k + 1, last=last, good=good)).otherwise(seen)

    n, m = F.size(ref), F.size(est)
    good = _walk(n + m, {"i": F.lit(0), "k": F.lit(0), "last": F.lit(-1), "good": F.lit(0)}, step, lambda s: s["good"])
    return F.when((n >= 2) & (m >= 2), good / F.greatest(n, m)).otherwise(0.0)


def any_continuity(ref: Column, est: Column) -> Column:
    """The best at the metrical level of the reference, at twice or half of it, or off the beat."""
    n = F.size(ref)
    between = F.zip_with(F.slice(ref, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ref, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: (a + b) / 2)
    twice = F.array_sort(F.concat(ref, between))
    every = lambda a, at: F.filter(a, lambda _, i: i % 2 == at)
    return F.array_max(F.transform(F.array(ref, twice, every(twice, 1), every(ref, 0), every(ref, 1)), lambda f: continuity(f, est)))


def beat_scores(beats: DataFrame, keys: list[str], ref: str = "ref", est: str = "est", ref_down: str = "ref_down", est_down: str = "est_down") -> DataFrame:
    """(keys, f_measure, cemgil, p_score, cmlt, amlt, downbeat_f_measure) of sorted arrays of beat times and downbeat times.

    All are NaN without reference beats, the periodic ones with fewer than two, the last without reference downbeats.
    """
    r, e, rd, ed = (F.col(c) for c in (ref, est, ref_down, est_down))
    nan = F.lit(float("nan"))
    of = lambda enough, c: F.when(enough, c).otherwise(nan)
    one, two = F.size(r) >= 1, F.size(r) >= 2
    return beats.select(
        *keys, of(one, f_measure(r, e)).alias("f_measure"), of(one, cemgil(r, e)).alias("cemgil"), of(two, p_score(r, e)).alias("p_score"), of(two, continuity(r, e)).alias("cmlt"),
        of(two, any_continuity(r, e)).alias("amlt"), of(F.size(rd) >= 1, f_measure(rd, ed)).alias("downbeat_f_measure"),
    )


def snapped(downs: DataFrame, beats: DataFrame, key: str, times: str = "times") -> DataFrame:
    """(key, times): each downbeat put on the nearest beat of its clip (the earlier of two), once; as it is where there is no beat."""
    each = lambda d: d.select(key, F.explode(times).alias("t"))
    near = nearest_event(each(downs), each(beats), key, "t")
    return near.groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce("nearest", "t"))).alias(times))


def with_downbeats(frames: DataFrame, key: str, order: str, beat: str, down: str, fps: float) -> DataFrame:
    """(key, beats, downs): the peaks of two curves, the second snapped to the first; every clip has a row."""
    from chunkline.operators.frames import peak_times

    beats, downs = (peak_times(frames, key, order, c, fps) for c in (beat, down))
    none = F.array().cast("array<double>")
    out = frames.select(key).distinct().join(beats.withColumnRenamed("times", "beats"), key, "left").join(snapped(downs, beats, key).withColumnRenamed("times", "downs"), key, "left")
    return out.select(key, F.coalesce("beats", none).alias("beats"), F.coalesce("downs", none).alias("downs"))
