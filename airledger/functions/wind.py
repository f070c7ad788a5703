"""Scalar functions of wind, grids and kernels: every one is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transport_x(wd: Column, ws: Column) -> Column:
    """Eastward transport of wind from ``wd`` degrees at speed ``ws``."""
    return -ws * F.sin(F.radians(wd))


def transport_y(wd: Column, ws: Column) -> Column:
    return -ws * F.cos(F.radians(wd))


def speed(ux: Column, vy: Column) -> Column:
    return F.hypot(ux, vy)


def direction(ux: Column, vy: Column) -> Column:
    """Degrees in [0, 360) that the wind comes from."""
    return F.pmod(F.degrees(F.atan2(-ux, -vy)), F.lit(360.0))


def direction_error(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def to_grid(x: Column, low: Column, high: Column, n: int) -> Column:
    """Min-max position on 0..n-1; a range below 1e-12 counts as that."""
    return (x - low) / F.greatest(high - low, F.lit(1e-12)) * (n - 1)


def cell(position: Column, n: int) -> Column:
    """Half-even rounding, clipped to the grid."""
    return F.least(F.greatest(F.rint(position), F.lit(0.0)), F.lit(float(n - 1))).cast("long")


def to_unit(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / F.greatest(high - low, F.lit(1e-9))


def displacement(speed_: Column, dt_s: float = 3600.0, dx_m: float = 1000.0) -> Column:
    if dt_s <= 0 or dx_m <= 0:
        raise ValueError("scales must be positive")
    return speed_ * (dt_s / dx_m)


def gaussian(d2: Column, length: float) -> Column:
    return F.exp(-0.5 * d2 / (length * length))


def puff(dx: Column, dy: Column, wx: Column, wy: Column, age: Column, along: float = 0.7, across: float = 0.25, least_age: float = 0.25, angle: float = 0.0) -> Column:
    """Oriented Gaussian density at (dx, dy); the axis is the mean wind (wx, wy), or ``angle`` radians when it is still."""
    from math import cos, sin

    norm = F.hypot(wx, wy)
    still = norm <= 1e-8
    ex = F.when(still, cos(angle)).otherwise(wx / norm)
    ey = F.when(still, sin(angle)).otherwise(wy / norm)
    old = F.greatest(age, least_age if isinstance(least_age, Column) else F.lit(least_age))
    vp, vq = along * along * old, across * across * old
    a, b = dx * ex + dy * ey, -dx * ey + dy * ex
    return F.exp(-0.5 * (a * a / vp + b * b / vq)) / (2 * F.pi() * F.sqrt(vp * vq))


def inside(x: Column, y: Column, nx: int, ny: int) -> Column:
    return x.between(-0.5, nx - 0.5) & y.between(-0.5, ny - 0.5)
