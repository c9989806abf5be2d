"""Models of points and cameras: triangulation, readings, agreement, alignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import geometry as g
from skerry.operators.aggregates import exact_percentiles

#: A track is seen once per image, so the views of a point are as many as a capture has images; pairs of views of a point
#: stay within that bound.
POSE = "struct<r00:double,r01:double,r02:double,r10:double,r11:double,r12:double,r20:double,r21:double,r22:double,t0:double,t1:double,t2:double>"


def widest_angles(obs: DataFrame, points: DataFrame, poses: DataFrame) -> DataFrame:
    """``point_idx, angle``: the widest angle under which two cameras see each point.

    ``obs(frame_idx, point_idx)``, ``points(point_idx, x, y, z)``, ``poses(image_idx, pose, valid)``; invalid poses and
    points with one view have no row.
    """
    c = g.centre(F.col("pose"))
    cams = poses.filter("valid").select(F.col("image_idx").alias("frame_idx"), *[v.alias(n) for v, n in zip(c, ("cx", "cy", "cz"))])
    rays = obs.select("frame_idx", "point_idx").distinct().join(cams, "frame_idx").join(points, "point_idx")
    rays = rays.select("point_idx", "frame_idx", *[(F.col(a) - F.col(b)).alias(n) for a, b, n in (("cx", "x", "u"), ("cy", "y", "v"), ("cz", "z", "w"))])
    other = rays.select("point_idx", *[F.col(n).alias(f"{n}2") for n in ("frame_idx", "u", "v", "w")])
    two = rays.join(other, "point_idx").filter("frame_idx < frame_idx2")
    return two.groupBy("point_idx").agg(F.max(g.angle_deg([F.col(n) for n in "uvw"], [F.col(f"{n}2") for n in "uvw"])).alias("angle"))


def reprojection(obs: DataFrame, points: DataFrame, poses: DataFrame, intrinsics: DataFrame) -> DataFrame:
    """Pixel error and depth of every observation; an error beyond the image extent or none at all is an escape.

    ``obs(frame_idx, point_idx, x, y)``, ``intrinsics(image_idx, k)``.
    """
    p = points.select("point_idx", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    j = obs.join(p, "point_idx").join(poses.filter("valid").select(F.col("image_idx").alias("frame_idx"), "pose"), "frame_idx").join(intrinsics.select(F.col("image_idx").alias("frame_idx"), "k"), "frame_idx")
    u, v, z = g.project(F.col("pose"), F.col("k"), (F.col("px"), F.col("py"), F.col("pz")))
    return j.select("frame_idx", "point_idx", F.hypot(u - F.col("x"), v - F.col("y")).alias("error"), z.alias("depth"))


def structure_readings(points: DataFrame, obs: DataFrame, poses: DataFrame) -> DataFrame:
    """One row: least points of a seen frame, share of two-view points, 95th percentile of error, 5th and 50th of widest angle."""
    one = F.lit(1).alias("_o")
    per = obs.groupBy("frame_idx").agg(F.count_distinct("point_idx").alias("n"))
    views = obs.groupBy("point_idx").agg(F.count_distinct("frame_idx").alias("n"))
    a = per.agg(F.min("n").alias("min_points")).withColumn("_o", F.lit(1))
    b = views.agg(F.avg((F.col("n") == 2).cast("double")).alias("two_view_share")).withColumn("_o", F.lit(1))
    e = exact_percentiles(points.select("error", one), ["_o"], "error", {"error_p95": 0.95})
    w = exact_percentiles(widest_angles(obs, points, poses).select("angle", one), ["_o"], "angle", {"angle_p05": 0.05, "angle_median": 0.5})
    out = a
    for x in (b, e, w):  # one row each
        out = out.join(F.broadcast(x), "_o", "left")
    return out.drop("_o")


def triage(errors: DataFrame, angles: DataFrame, max_error: float, min_angle: float) -> DataFrame:
    """Why points are refused, first reason first, with counts: behind a camera, error, angle, or kept."""
    worst = errors.groupBy("point_idx").agg(F.min("depth").alias("depth"), F.max("error").alias("error"))
    r = worst.join(angles, "point_idx", "left")
    reason = F.when(F.col("depth") <= 0, "behind").when(F.col("error").isNull() | F.isnan("error") | (F.col("error") > max_error), "error").when(F.col("angle").isNull() | (F.col("angle") < min_angle), "angle").otherwise("kept")
    return r.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("points"))


def triangulate(views: DataFrame) -> DataFrame:
    """``point_idx, x, y, z, views``: linear triangulation from all views of a point.

    ``views(point_idx, pose, u, v)`` with normalised image coordinates. The normal matrix of the linear system is summed by
    Spark (ten sums per point, with map-side combine), so no point's views are gathered; the smallest eigenvector of each
    4 x 4 matrix is then taken for whole batches at once. Points with one view have no row.
    """
    p = F.col("pose")
    row = lambda i: [p[f"r{i}0"], p[f"r{i}1"], p[f"r{i}2"], p[f"t{i}"]]
    eqs = [[F.col(c) * z - x for x, z in zip(row(i), row(2))] for c, i in (("u", 0), ("v", 1))]
    sums = [F.sum(sum((e[i] * e[j] for e in eqs), F.lit(0.0))).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)]
    m = views.groupBy("point_idx").agg(F.count(F.lit(1)).alias("views"), *sums).filter("views >= 2")
    names = [f"m{i}{j}" for i in range(4) for j in range(i, 4)]

    def solve(parts):
        for d in parts:
            a = np.zeros((len(d), 4, 4))
            for n in names:
                i, j = int(n[1]), int(n[2])
                a[:, i, j] = a[:, j, i] = d[n]
            w = np.linalg.eigh(a)[1][:, :, 0] if len(d) else np.zeros((0, 4))
            x = w[:, :3] / w[:, 3:]
            yield pd.DataFrame({"point_idx": d["point_idx"], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "views": d["views"]})

    kind = m.schema["point_idx"].dataType.simpleString()
    return m.mapInPandas(solve, f"point_idx {kind}, x double, y double, z double, views bigint")


def similarity(pairs: DataFrame) -> DataFrame:
    """The similarity that best maps (ax, ay, az) onto (bx, by, bz): one row ``scale, r00 .. r22, t0, t1, t2, n``.

    All sums are taken by Spark; only their one row is solved on the driver.
    """
    a, b = [F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"]
    r = pairs.agg(F.count(F.lit(1)), *[F.avg(x) for x in (*a, *b)], *[F.avg(x * y) for y in b for x in a], F.avg(g.dot(a, a))).first()
    n, spark = int(r[0]), pairs.sparkSession
    names = ["scale", *[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2", "n"]
    schema = ", ".join(f"{c} {'bigint' if c == 'n' else 'double'}" for c in names)
    if n < 3:
        return spark.createDataFrame([], schema)
    ma, mb = np.array(r[1:4]), np.array(r[4:7])
    cov = np.array(r[7:16]).reshape(3, 3) - np.outer(mb, ma)
    var = r[16] - ma @ ma
    u, d, vt = np.linalg.svd(cov)
    sign = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    rot = u @ sign @ vt
    scale = float((d * np.diag(sign)).sum() / var) if var > 0 else 1.0
    t = mb - scale * rot @ ma
    return spark.createDataFrame([(scale, *map(float, rot.ravel()), *map(float, t), n)], schema)


def rotation_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Median and 90th percentile of the difference in relative rotation, over all pairs of cameras that both have.

    Poses ``(scope, image_idx, pose, valid)``; pairs are formed within a scope (one capture's cameras).
    """
    both = a.filter("valid").select("scope", "image_idx", F.col("pose").alias("pa")).join(b.filter("valid").select("scope", "image_idx", F.col("pose").alias("pb")), ["scope", "image_idx"])
    o = both.select("scope", *[F.col(c).alias(f"{c}2") for c in ("image_idx", "pa", "pb")])
    two = both.join(o, "scope").filter("image_idx < image_idx2")
    rel = lambda p, q: [g.dot([F.col(q)[f"r{i}{k}"] for k in range(3)], [F.col(p)[f"r{j}{k}"] for k in range(3)]) for i in range(3) for j in range(3)]
    trace = g.dot(rel("pa", "pa2"), rel("pb", "pb2"))
    ang = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
    return exact_percentiles(two.select("scope", ang.alias("d")), ["scope"], "d", {"median_deg": 0.5, "p90_deg": 0.9})


def fill_poses(core: DataFrame, other: DataFrame) -> DataFrame:
    """The core's valid poses, and those of ``other`` for cameras it lacks; ``filled`` tells them apart."""
    have = core.filter("valid")
    extra = other.filter("valid").join(have.select("image_idx"), "image_idx", "left_anti")
    return have.select("image_idx", "pose", F.lit(False).alias("filled")).unionByName(extra.select("image_idx", "pose", F.lit(True).alias("filled")))


def per_image_intrinsics(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Intrinsics of each image: by its camera index if set, else its own number if there are as many cameras as images,
    else the first camera. ``images(image_idx, camera_idx)``, ``cameras(camera_idx, k)``."""
    n = images.agg(F.count(F.lit(1)).alias("ni")).join(F.broadcast(cameras.agg(F.count(F.lit(1)).alias("nk"))))  # one row
    at = F.coalesce(F.col("camera_idx"), F.when(F.col("nk") == F.col("ni"), F.col("image_idx")).otherwise(F.lit(0)))
    return images.join(F.broadcast(n)).select("image_idx", at.alias("camera_idx")).join(cameras, "camera_idx", "left").select("image_idx", "k")


def depth_views(df: DataFrame, px: str, py: str, depth: str, colour: str) -> DataFrame:
    """Z-buffer: the nearest point of each pixel."""
    return df.groupBy(px, py).agg(F.min_by(colour, F.struct(depth, colour)).alias(colour), F.min(depth).alias(depth))


def worst_frames(errors: DataFrame, width: int, scope: Sequence[str] = ()) -> DataFrame:
    """Frames of each scope in order, at most ``width`` either side of the frame of the greatest error (the first of equals)."""
    scope = list(scope)
    w = Window.partitionBy(*scope).orderBy("frame_idx")  # one row per frame of a capture
    per = errors.groupBy(*scope, "frame_idx").agg(F.max("error").alias("error")).withColumn("_r", F.row_number().over(w))
    top = F.max_by("_r", F.struct("error", -F.col("_r"))).over(Window.partitionBy(*scope))
    return per.withColumn("_top", top).filter(F.abs(F.col("_r") - F.col("_top")) <= width).drop("_r", "_top")
