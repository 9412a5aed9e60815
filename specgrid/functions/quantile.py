"""Quantiles and curves as column expressions over sorted arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 200


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once, however often f reads it."""
    return F.transform(F.array(value), f)[0]


def quantile_type8(values: Column, p: Column | float) -> Column:
    """Type-8 quantile of a sorted array: place h = (n + 1/3) p + 1/3, kept inside the array, linear between neighbours."""
    n = F.size(values)

    def at(h: Column) -> Column:
        low = F.floor(h).cast("int")
        below = F.element_at(values, low)
        return F.when(h > low, below + (h - low) * (F.element_at(values, F.least(low + 1, n)) - below)).otherwise(below)

    h = (n + F.lit(1 / 3)) * (F.lit(p) if isinstance(p, float) else p) + F.lit(1 / 3)
    return let(F.least(F.greatest(h, F.lit(1.0)), n.cast("double")), at)


def read_knots(curve: Column, tau: Column, grid: int = GRID) -> Column:
    """A curve's `grid` knots on [0, 1], read at tau by linear interpolation."""
    at = F.greatest(F.least(tau, F.lit(1.0)), F.lit(0.0)) * (grid - 1)
    right = F.greatest(F.least(F.ceil(at), F.lit(grid - 1)), F.lit(1)).cast("int")
    low = F.element_at(curve, right)
    return low + (at - (right - 1)) * (F.element_at(curve, right + 1) - low)


def inverse_on_grid(curve: Column, value: Column) -> Column:
    """Where a non-decreasing curve on evenly spaced knots of [0, 1] reaches value; its ends outside; the lower knot on a flat piece."""
    n = F.size(curve)
    # knots below the value: the first one that isn't comes after them
    before = F.size(F.filter(curve, lambda y: y < value))
    low, high = F.element_at(curve, F.greatest(before, F.lit(1))), F.element_at(curve, F.least(before + 1, n))
    inner = F.when(F.abs(high - low) < 2.220446049250313e-16, F.lit(0.0)).otherwise((value - low) / (high - low))
    return F.when(value <= F.element_at(curve, 1), 0.0).when(value >= F.element_at(curve, -1), 1.0).otherwise((before - 1 + inner) / (n - 1))


def interpolate(xs: Column, ys: Column, x: Column) -> Column:
    """Linear interpolation through the points (xs sorted, ys), constant outside."""
    before = F.size(F.filter(xs, lambda v: v < x))
    i, j = F.greatest(before, F.lit(1)), F.least(before + 1, F.size(xs))
    x0, x1, y0, y1 = F.element_at(xs, i), F.element_at(xs, j), F.element_at(ys, i), F.element_at(ys, j)
    return F.when(x <= F.element_at(xs, 1), F.element_at(ys, 1)).when(x >= F.element_at(xs, -1), F.element_at(ys, -1)).otherwise(y0 + F.when(x1 > x0, (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(0.0))


def ecdf(values: Column, x: Column) -> Column:
    """Share of the array's values that are at most x."""
    return F.size(F.filter(values, lambda v: v <= x)) / F.size(values)
