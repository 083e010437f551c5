"""Smoothing splines of tracks (track, t, x, y) on a regular grid of times.

Of all curves whose squared residuals sum to a bound the one of least curvature is a natural cubic spline. Its second
derivatives solve a system of five diagonals; the weight of the residuals is found by halving.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Halvings of the weight's logarithm, and its range around the scale of the times.
HALVINGS, RANGE = 60, 16


def _solved(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of a symmetric positive system with diagonals d0, d1 and d2, by factors L D L'."""
    n = len(d0)
    d, l1, l2, z = ([0.0] * n for _ in range(4))
    a0, a1, a2, rhs = d0.tolist(), d1.tolist(), d2.tolist(), b.tolist()
    for i in range(n):
        before, past = i - 1, i - 2
        d[i], z[i] = a0[i], rhs[i]
        if i >= 1:
            d[i] -= l1[before] ** 2 * d[before]
            z[i] -= l1[before] * z[before]
        if i >= 2:
            d[i] -= l2[past] ** 2 * d[past]
            z[i] -= l2[past] * z[past]
        if i + 1 < n:
            l1[i] = (a1[i] - (l2[before] * d[before] * l1[before] if i >= 1 else 0.0)) / d[i]
        if i + 2 < n:
            l2[i] = a2[i] / d[i]
    for i in reversed(range(n)):
        z[i] = z[i] / d[i] - (l1[i] * z[i + 1] if i + 1 < n else 0.0) - (l2[i] * z[i + 2] if i + 2 < n else 0.0)
    return np.array(z)


def smoothed(t: np.ndarray, y: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(values, second derivatives) at the times of the smoothest curve with squared residuals of at most ``bound``."""
    n, h = len(t), np.diff(t)
    q0, q1, q2 = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    target = q0 * y[:-2] + q1 * y[1:-1] + q2 * y[2:]
    r0, r1, r2 = (h[:-1] + h[1:]) / 3, h[1:-1] / 6, np.zeros(max(0, n - 4))
    s0, s1, s2 = q0**2 + q1**2 + q2**2, q1[:-1] * q0[1:] + q2[:-1] * q1[1:], q2[:-2] * q0[2:]

    def spread(g: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[:-2] += q0 * g
        out[1:-1] += q1 * g
        out[2:] += q2 * g
        return out

    def curve(weight: float) -> tuple[np.ndarray, np.ndarray]:
        g = _solved(r0 + weight * s0, r1 + weight * s1, r2 + weight * s2, target)
        return weight * spread(g), g

    line = np.polyval(np.polyfit(t - t[0], y, 1), t - t[0])
    if ((y - line) ** 2).sum() <= bound:
        return line, np.zeros(n)
    if bound <= 0:
        return y.copy(), np.r_[0.0, curve(0.0)[1], 0.0]
    middle = 3 * math.log(float(h.mean()))
    low, high = middle - RANGE * math.log(10), middle + RANGE * math.log(10)
    for _ in range(HALVINGS):
        weight = (low + high) / 2
        residual, _ = curve(math.exp(weight))
        low, high = (weight, high) if (residual**2).sum() < bound else (low, weight)
    residual, g = curve(math.exp(low))
    return y - residual, np.r_[0.0, g, 0.0]


def at_times(t: np.ndarray, values: np.ndarray, second: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The spline at ``times``; before the first and after the last it keeps its end values."""
    times = np.clip(times, t[0], t[-1])
    k = np.clip(np.searchsorted(t, times, "right") - 1, 0, len(t) - 2)
    h, a = t[k + 1] - t[k], (times - t[k]) / (t[k + 1] - t[k])
    b = 1 - a
    return b * values[k] + a * values[k + 1] + ((b**3 - b) * second[k] + (a**3 - a) * second[k + 1]) * h * h / 6


def regular_tracks(points: DataFrame, step: float = 1.0, smoothing: float | None = None) -> DataFrame:
    """(track, place, t, x, y) of each track on times from its first by ``step`` until its last is reached.

    ``smoothing`` bounds the squared residuals of each coordinate, by default their number; 0 goes through all points. Points
    of one time are averaged first, those with a null have no part, and tracks of fewer than four times have no row. A
    track is one group: its spline is one system.
    """
    whole = points.select("track", *[F.col(c).cast("double").alias(c) for c in "txy"]).dropna().groupBy("track", "t").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, n = table.column("t").to_numpy(), table.num_rows
        times = np.arange(t[0], t[-1] + step, step) if n >= 4 else np.zeros(0)
        out = {"track": table.column("track").take(pa.array(np.zeros(len(times), np.int64))), "place": np.arange(len(times)), "t": times}
        for c in "xy":
            out[c] = at_times(t, *smoothed(t, table.column(c).to_numpy(), n if smoothing is None else smoothing), times) if n >= 4 else times
        return pa.table(out)

    return whole.groupBy("track").applyInArrow(one, f"track {whole.schema['track'].dataType.simpleString()}, place long, t double, x double, y double")
