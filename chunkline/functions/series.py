"""Frame series as array expressions: resampling, padding, scaling, smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(m: int) -> Column:
    return F.sequence(F.lit(0), F.lit(m - 1)) if m else F.array().cast("array<int>")


def _between(a: Column, pos: Column) -> Column:
    lo = F.floor(pos).cast("int")
    hi = F.least(lo + 1, F.size(a) - 1)
    x, y = F.get(a, lo), F.get(a, hi)
    return x + (pos - lo) * (y - x)


def resample_linear(a: Column, m: int) -> Column:
    """``m`` values on an even grid over the series, both ends kept."""
    return F.transform(_steps(m), lambda k: _between(a, k * (F.size(a) - 1) / F.lit(max(m - 1, 1))))


def resample_nearest(a: Column, m: int) -> Column:
    """As above with the nearest value; halves go down."""
    return F.transform(_steps(m), lambda k: F.get(a, F.greatest(F.ceil(k * (F.size(a) - 1) / F.lit(max(m - 1, 1)) - 0.5), F.lit(0)).cast("int")))


def resample_clock(a: Column, m: int, src_fps: float, dst_fps: float) -> Column:
    """``m`` frames of another clock, held at the ends."""
    return F.transform(_steps(m), lambda k: _between(a, F.least(k * F.lit(src_fps / dst_fps), (F.size(a) - 1).cast("double"))))


def align_pad(a: Column, n: int, zero: Column) -> Column:
    """Cut or zero-padded to ``n`` frames."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(zero, F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def pitch_norm(hz: Column, lo: float = 50.0, hi: float = 1000.0, floor: float = 0.05) -> Column:
    """Voiced pitch on a log scale from ``floor`` to 1; 0 stays unvoiced."""
    span = float(np.log2(hi) - np.log2(lo)) + 1e-8
    f = F.greatest(F.least(hz, F.lit(hi)), F.lit(lo))
    return F.when(hz > 0, floor + (1 - floor) * (F.log2(f) - float(np.log2(lo))) / span).otherwise(0.0)


def pitch_hz(norm: Column, lo: float = 50.0, hi: float = 1000.0, floor: float = 0.05) -> Column:
    span = float(np.log2(hi) - np.log2(lo)) + 1e-8
    u = F.greatest(F.least((norm - floor) / (1 - floor), F.lit(1.0)), F.lit(0.0))
    return F.when(norm > 0, F.pow(F.lit(2.0), float(np.log2(lo)) + u * span)).otherwise(0.0)


def energy_norm(rms: Column, top: float = 80.0) -> Column:
    return F.greatest(F.least((20 * F.log10(rms + 1e-7) + top) / top, F.lit(1.0)), F.lit(0.0))


def logit_curve(x: Column) -> Column:
    return F.greatest(F.least(1 / (1 + F.exp(-x)), F.lit(1.0)), F.lit(0.0))


def signed_round(x: Column, digits: int) -> Column:
    """Rounded, halves away from zero; what rounds to zero from below is -0.0, as in SQL engines that round the number itself."""
    return F.round(F.abs(x), digits) * F.signum(x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_similarity(a: Column, b: Column) -> Column:
    """Cosine; null where either vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def polynomial_weights(win: int, order: int = 3) -> list[list[float]]:
    """Row r gives the value at place r of the polynomial fitted to ``win`` values."""
    a = np.vander(np.arange(win, dtype=float), order + 1)
    return (a @ np.linalg.pinv(a)).tolist()


def polynomial_window(fps: float, length: int, order: int = 3) -> int:
    """One second of frames, odd, at least order + 2; 0 if the series is shorter."""
    win = max(round(fps), order + 2)
    win += 1 - win % 2
    return win if win <= length else 0


def polynomial_smooth(a: Column, win: int, order: int = 3) -> Column:
    """Least-squares polynomial smoothing; the ends take the values of the fit to the first and last window."""
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in polynomial_weights(win, order)])

    def value(_: Column, i: Column) -> Column:
        s = F.greatest(F.least(i - win // 2, F.size(a) - win), F.lit(0))
        row = F.get(table, i - s)
        return F.aggregate(F.zip_with(row, F.slice(a, s + 1, win), lambda w, x: w * x), F.lit(0.0), lambda t, x: t + x)

    return F.when(F.size(a) >= win, F.transform(a, value)).otherwise(a)
