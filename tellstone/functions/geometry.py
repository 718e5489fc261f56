"""Angles and distances as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if not isinstance(x, str) else F.col(x)


def distance(ax, ay, az, bx, by, bz) -> Column:
    return F.sqrt(F.pow(_c(ax) - _c(bx), 2) + F.pow(_c(ay) - _c(by), 2) + F.pow(_c(az) - _c(bz), 2))


def angle_diff(a, b) -> Column:
    """a - b in degrees, above -180 and up to 180."""
    d = F.pmod(_c(a) - _c(b) + 180, F.lit(360.0)) - 180
    return F.when(d <= -180, d + 360).otherwise(d)


def desired(dx, dy, dz) -> tuple[Column, Column]:
    """Pitch and yaw that look along (dx, dy, dz); pitch is positive downwards."""
    flat = F.hypot(_c(dx), _c(dy))
    pitch = F.when((flat == 0) & (_c(dz) == 0), 0.0).otherwise(-F.degrees(F.atan2(_c(dz), flat)))
    return pitch, F.degrees(F.atan2(_c(dy), _c(dx)))


def vector(pitch, yaw) -> tuple[Column, Column, Column]:
    p, y = F.radians(_c(pitch)), F.radians(_c(yaw))
    return F.cos(p) * F.cos(y), F.cos(p) * F.sin(y), -F.sin(p)


def spherical(pitch_a, yaw_a, pitch_b, yaw_b) -> Column:
    """Degrees between two directions, to a billionth, so that how a sum is rounded decides no comparison; null where either is."""
    a, b = vector(pitch_a, yaw_a), vector(pitch_b, yaw_b)
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    # greatest and least pass over nulls.
    return F.when(dot.isNotNull(), F.rint(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))) * 1e9) / 1e9)


def aim_error(me: str, him: str) -> Column:
    """Degrees between where me looks and where him stands; both are prefixes of columns."""
    pitch, yaw = desired(F.col(f"{him}x") - F.col(f"{me}x"), F.col(f"{him}y") - F.col(f"{me}y"), F.col(f"{him}z") - F.col(f"{me}z"))
    return spherical(F.col(f"{me}pitch"), F.col(f"{me}yaw"), pitch, yaw)


def in_fov(me: str, him: str, fov: float) -> Column:
    return aim_error(me, him) <= fov


def clamp01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def ramp(x, low: float, high: float) -> Column:
    """0 at low, 1 at high, straight between; falls if low is above high, 0 if they are equal."""
    if low == high:
        return F.lit(0.0)
    return clamp01((_c(x) - low) / (high - low))


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def mean(x) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def stdev(x) -> Column:
    """Of the sample; 0 with fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def shown(x) -> Column:
    """x to six places, halves up; to nine first, so that the last bits of x decide no half."""
    return F.round(F.rint(_c(x) * 1e9) / 1e3) / 1e6


def median(x) -> Column:
    return F.coalesce(F.median(x), F.lit(0.0))


def array_mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)).otherwise(0.0)


def array_stdev(x: Column) -> Column:
    """Of the sample, in one pass; 0 with fewer than two values."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a: Column, v: Column) -> Column:
        n, d = a["n"] + 1, v - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d / n).alias("mean"), (a["m2"] + d * d * (n - 1) / n).alias("m2"))

    return F.aggregate(x, start, step, lambda a: F.when(a["n"] > 1, F.sqrt(a["m2"] / (a["n"] - 1))).otherwise(0.0))
