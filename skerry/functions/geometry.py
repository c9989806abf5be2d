"""Camera geometry as column expressions, so that it stays inside generated code.

A pose is a struct of nine rotation entries ``r00 .. r22`` and a shift ``t0, t1, t2`` (world to camera), intrinsics a
struct ``fx, fy, cx, cy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def _rot(p: Column, i: int, j: int) -> Column:
    return p[f"r{i}{j}"]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def angle_deg(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle between two rays; null where one has no length."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def to_camera(p: Column, x: Vec) -> Vec:
    return tuple(dot([_rot(p, i, j) for j in range(3)], x) + p[f"t{i}"] for i in range(3))  # type: ignore[return-value]


def centre(p: Column) -> Vec:
    """Camera centre, minus the transposed rotation times the shift."""
    return tuple(-dot([_rot(p, j, i) for j in range(3)], [p[f"t{j}"] for j in range(3)]) for i in range(3))  # type: ignore[return-value]


def project(p: Column, k: Column, x: Vec) -> tuple[Column, Column, Column]:
    """Pixel and depth of a point; pixel is null at depth 0."""
    cx, cy, z = to_camera(p, x)
    return k["fx"] * F.try_divide(cx, z) + k["cx"], k["fy"] * F.try_divide(cy, z) + k["cy"], z


def unproject(p: Column, k: Column, u: Column, v: Column, depth: Column) -> Vec:
    """World point of a pixel at a depth."""
    cam = ((u - k["cx"]) / k["fx"] * depth, (v - k["cy"]) / k["fy"] * depth, depth)
    off = [cam[i] - p[f"t{i}"] for i in range(3)]
    return tuple(dot([_rot(p, j, i) for j in range(3)], off) for i in range(3))  # type: ignore[return-value]


def rotation_angle_deg(a: Column, b: Column) -> Column:
    """Angle of the rotation from one pose to another, from the trace of a times b transposed."""
    trace = dot([_rot(a, i, j) for i in range(3) for j in range(3)], [_rot(b, i, j) for i in range(3) for j in range(3)])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def distort(x: Column, y: Column, k1: Column, k2: Column, p1: Column, p2: Column, k3: Column) -> tuple[Column, Column]:
    """Radial and tangential distortion of normalised coordinates."""
    r2 = x * x + y * y
    f = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * f + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * f + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def undistort(x: Column, y: Column, k1: Column, k2: Column, p1: Column, p2: Column, k3: Column, rounds: int = 10) -> Column:
    """struct(x, y) of the undistorted point by fixed-point rounds (a fold, so the expression stays small)."""

    def step(s: Column, _: Column) -> Column:
        dx, dy = distort(s["x"], s["y"], k1, k2, p1, p2, k3)
        return F.struct((s["x"] + x - dx).alias("x"), (s["y"] + y - dy).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), step)


def sampson(f: Sequence[Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Squared Sampson distance of a match under a fundamental matrix given by rows (nine columns)."""
    one = F.lit(1.0)
    x, y = (a[0], a[1], one), (b[0], b[1], one)
    fx = [dot(f[3 * i : 3 * i + 3], x) for i in range(3)]
    ft = [dot([f[i], f[3 + i], f[6 + i]], y) for i in range(3)]
    e = dot(y, fx)
    return F.try_divide(e * e, fx[0] * fx[0] + fx[1] * fx[1] + ft[0] * ft[0] + ft[1] * ft[1])


def transfer_error(h: Sequence[Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Distance of the second point from the first one mapped by a homography (nine columns)."""
    x = (a[0], a[1], F.lit(1.0))
    u, v, w = (dot(h[3 * i : 3 * i + 3], x) for i in range(3))
    return F.hypot(F.try_divide(u, w) - b[0], F.try_divide(v, w) - b[1])


def root_sift(v: Column) -> Column:
    """L1-normalised square roots of a descriptor."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return F.transform(v, lambda x: F.sqrt(F.try_divide(F.abs(x.cast("double")), total)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def fit_size(w: Column, h: Column, longest: int) -> tuple[Column, Column]:
    """Size after shrinking the longer edge to ``longest``, rounded half to even; never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    return F.greatest(F.lit(1), F.rint(w * scale).cast("int")), F.greatest(F.lit(1), F.rint(h * scale).cast("int"))


def health(value: Column, direction: Column, lo: Column, hi: Column) -> Column:
    """good, warning or unknown: a null value or an absent band is unknown; a missing bound is open."""
    inside = (lo.isNull() | (value >= lo)) & (hi.isNull() | (value <= hi))
    return F.when(value.isNull() | F.isnan(value.cast("double")) | (lo.isNull() & hi.isNull()) | direction.isNull(), "unknown").when(inside, "good").otherwise("warning")
