"""Matching and beat measures with plain lists, to hold the folds against."""

import numpy as np


def greedy_matches(ref: list[float], est: list[float], tolerance: float) -> int:
    """Most one-to-one matches of two sorted lists: with one tolerance on a line, the earliest match is the best."""
    i = j = n = 0
    while i < len(ref) and j < len(est):
        d = round(est[j] - ref[i], 4)
        if abs(d) <= tolerance:
            n, i, j = n + 1, i + 1, j + 1
        elif d > 0:
            i += 1
        else:
            j += 1
    return n


def continuity(ref: np.ndarray, est: np.ndarray, limit: float = 0.175) -> float:
    """Share of estimated beats that keep the phase and period of the reference."""
    if len(ref) < 2 or len(est) < 2:
        return 0.0
    good, used = np.zeros(max(len(ref), len(est)), bool), np.zeros(len(ref), bool)
    for i, t in enumerate(est):
        k = int(np.abs(ref - t).argmin())
        if used[k]:
            continue
        a, b = (k, k + 1) if k == 0 or i == 0 else (k - 1, k)
        c, d = (i, i + 1) if k == 0 or i == 0 else (i - 1, i)
        if b >= len(ref) or d >= len(est):
            continue
        period = ref[b] - ref[a]
        if abs(t - ref[k]) / period < limit and abs(1 - (est[d] - est[c]) / period) < limit:
            good[i] = used[k] = True
    return float(good.sum() / len(good))


def beat_measures(ref: np.ndarray, est: np.ndarray) -> tuple[float, float, float, float, float]:
    """F-measure, Cemgil, P-score, CMLt and AMLt of two sorted lists of beats."""
    nan_ = float("nan")
    if not len(ref):
        return (nan_,) * 5
    m = greedy_matches(list(ref), list(est), 0.07)
    f = 2 * m / (len(ref) + len(est))
    near = np.abs(ref[:, None] - est[None, :]).min(1) if len(est) else np.full(len(ref), np.inf)
    cemgil = float(np.exp(-(near**2) / (2 * 0.04**2)).sum() / (0.5 * (len(ref) + len(est))))
    if len(ref) < 2:
        return f, cemgil, nan_, nan_, nan_
    win = int(round(0.2 * np.median(np.diff(np.round(ref * 100)))))
    gaps = np.round(ref * 100)[:, None] - np.round(est * 100)[None, :]
    p = float((np.abs(gaps) <= win).sum() / max(len(ref), len(est)))
    mid = np.sort(np.concatenate([ref, (ref[1:] + ref[:-1]) / 2]))
    forms = [ref, mid, mid[1::2], ref[::2], ref[1::2]]
    return f, cemgil, min(p, 1.0), continuity(ref, est), max(continuity(x, est) for x in forms)
