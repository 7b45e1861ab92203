"""Tone curves and look-up tables, worked out once on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def spline3(xs: tuple, ys: tuple, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through three knots: one interior second derivative."""
    (x0, x1, x2), (y0, y1, y2) = xs, ys
    h0, h1 = x1 - x0, x2 - x1
    bend = 3 * ((y2 - y1) / h1 - (y1 - y0) / h0) / (h0 + h1)
    u, v = at - x0, x2 - at
    left = bend * u**3 / (6 * h0) + y0 * (x1 - at) / h0 + (y1 / h0 - bend * h0 / 6) * u
    right = bend * v**3 / (6 * h1) + y2 * (at - x1) / h1 + (y1 / h1 - bend * h1 / 6) * v
    return np.where(at <= x1, left, right)


def tone_curve(depth: int, ev: float = 0.0, shadow: float = 0, contrast: float = 0, highlight: float = 0, reverse_gamma: bool = False, gamma: float = 2.4, standard: bool = False) -> np.ndarray:
    """Output in 0..1 for every input value of a depth.

    The gamma branch has the offset inside the power unless `standard` asks for
    the common form.
    """
    most, unit, gain = (1 << depth) - 1, ((1 << depth) - 1) // 200, 2.0**ev
    at = np.arange(most + 1, dtype=np.float64)
    knots = (0, most // 2, most)
    values = ((shadow - contrast) * unit * gain, (most // 2) * gain, (most + (contrast + highlight) * unit) * gain)
    curve = spline3(knots, values, at)
    if not reverse_gamma:
        return np.where(curve > most, 1.0, curve / most)
    n = curve / most
    high = np.maximum(n, 0.0031308)
    bent = 1.055 * high ** (1 / gamma) - 0.055 if standard else (1.055 * high) ** (1 / gamma) - 0.055
    return np.minimum(np.where(n <= 0.0031308, n * 12.92, bent), 1.0)


def cubic_fit(xs: list[float], ys: list[float]) -> list[float]:
    """Coefficients of the least-squares cubic, lowest power first."""
    return np.polynomial.polynomial.polyfit(xs, ys, 3).tolist()


def gamma_table(power: float, slope: float, depth: int = 16) -> list[int]:
    """A gamma curve with a linear toe: slope * x, then (1 + a) * x^power - a.

    a and the knee follow from equal value and slope where the parts meet; the knee
    is found by bisection, as far as doubles go.
    """

    def gap(knee: float) -> float:
        a = slope * knee ** (1 - power) / power - 1
        return (1 + a) * knee**power - a - slope * knee

    knee = a = 0.0
    if 0 < power < 1 and slope > 1:
        low, high = 1e-12, 1.0
        for _ in range(48):
            knee = (low + high) / 2
            if gap(knee) > 0:
                low = knee
            else:
                high = knee
        a = slope * knee ** (1 - power) / power - 1
    most = (1 << depth) - 1
    x = np.arange(most + 1) / most
    bent = (1 + a) * x**power - a if power > 0 else x
    y = np.where(x < knee, slope * x, bent)
    return np.trunc(np.clip(y, 0, 1) * most).astype(np.int64).tolist()


def lut(curve: np.ndarray, scale: int) -> list[int]:
    """A curve in 0..1 as whole numbers."""
    return np.clip(np.trunc(curve * scale), 0, scale).astype(np.int64).tolist()


def compose(first: list[int], then: list[int]) -> list[int]:
    """One table for two that are applied in turn."""
    return [then[min(len(then) - 1, v)] for v in first]


def apply_lut(v: Column, table: list[int]) -> Column:
    """Table look-up by an array literal, for tables of bounded size."""
    return F.element_at(F.expr(f"array({', '.join(str(int(t)) for t in table)})"), v.cast("int") + 1)


def exposure(ev: float) -> float:
    return 2.0**ev


def exposure_value(gain: float) -> float:
    return math.log2(gain)
