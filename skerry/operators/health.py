"""Readings of a reconstruction's health: errors, coverage, agreement of camera models, losses between two models.

Readings that are undefined are null, never a pass. All are keyed by scope (a capture or model), so many models are read in one
plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import geometry as g
from skerry.operators.aggregates import exact_percentiles
from skerry.operators.geometry import rotation_agreement

#: Share of escaped points from which a solve counts as diverged, and the growth of the tail that does (fixed values).
DIVERGED_SHARE, BLOWN = 0.05, 1e3
#: Views from which a point counts as well supported, and the ratio from which two estimators fire (fixed values).
MIN_SUPPORT, FIRE_LEVEL = 3, 2.0
#: Windows of a second solve: the usual one and the last resort (fixed values).
WINDOWS = ((28, "default"), (40, "last_resort"))


def escaped(error: Column, extent: Column) -> Column:
    """Whether an error is none that a point of this image can have: null, not finite, or beyond the image extent."""
    return F.coalesce(F.isnan(error) | (F.abs(error) == float("inf")) | (error > extent), F.lit(True))


def error_readings(df: DataFrame, scope: Sequence[str], before: str, after: str, extent: Column) -> DataFrame:
    """Of each scope: points, escaped points and their share, means and 95th percentiles before and after, without what
    escaped, and whether the solve diverged (all escaped, ``DIVERGED_SHARE`` of them, or a tail that grew ``BLOWN``-fold)."""
    scope = list(scope)
    gone = escaped(F.col(after), extent)
    t = df.select(*scope, gone.alias("_out"), F.when(~gone, F.col(after)).alias("_a"), F.when(~escaped(F.col(before), extent), F.col(before)).alias("_b"))
    agg = t.groupBy(*scope).agg(F.count(F.lit(1)).alias("points"), F.count_if("_out").alias("escaped"), F.avg("_b").alias("mean_before"), F.avg("_a").alias("mean_after"))
    for c, n in (("_b", "p95_before"), ("_a", "p95_after")):
        agg = agg.join(exact_percentiles(t, scope, c, {n: 0.95}), scope, "left")
    share = F.col("escaped") / F.col("points")
    blew = (F.col("escaped") == F.col("points")) | (share >= DIVERGED_SHARE) | F.coalesce(F.col("p95_after") > BLOWN * F.greatest("p95_before", F.lit(1e-6)), F.lit(False))
    return agg.withColumn("escaped_share", share).withColumn("diverged", blew)


def components(points: DataFrame, obs: DataFrame, cameras: DataFrame, scope: Sequence[str], focal: DataFrame | None = None, tracks: DataFrame | None = None) -> DataFrame:
    """Raw readings of each scope in one row.

    ``points(scope, point_idx, error)``, ``obs(scope, frame_idx, point_idx)``, ``cameras(scope, image_idx, valid)``, one row
    for each image of the scope; ``focal(scope, focal)`` and ``tracks(scope, track_id)``, one row per observation of the
    tracks the model was built from, are optional and leave their readings null. Registration: share of valid cameras.
    Composition: share of seen points with more than two views. Error: median error of points of ``MIN_SUPPORT`` views or
    more, in pixels and, by the focal length, in milliradians. Yields: observations and points against those of the tracks.
    """
    scope = list(scope)
    length = obs.groupBy(*scope, "point_idx").agg(F.count(F.lit(1)).alias("len"))
    cam = cameras.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_images"), F.count_if("valid").alias("registered_images"))
    seen = length.groupBy(*scope).agg(F.avg((F.col("len") >= 3).cast("double")).alias("composition"), F.sum("len").alias("observation_count"))
    n = points.groupBy(*scope).agg(F.count(F.lit(1)).alias("point_count"))
    good = points.join(length, [*scope, "point_idx"]).filter((F.col("len") >= MIN_SUPPORT) & ~F.isnan("error") & (F.abs("error") < float("inf")))
    out = cam.join(n, scope, "left").join(seen, scope, "left").join(exact_percentiles(length, scope, "len", {"median_support": 0.5}), scope, "left").join(exact_percentiles(good, scope, "error", {"error_px": 0.5}), scope, "left")
    out = out.join(focal, scope, "left") if focal is not None else out.withColumn("focal", F.lit(None).cast("double"))
    if tracks is not None:
        out = out.join(tracks.groupBy(*scope).agg(F.count(F.lit(1)).alias("_to"), F.count_distinct("track_id").alias("_tc")), scope, "left")
    else:
        out = out.withColumns({"_to": F.lit(None).cast("bigint"), "_tc": F.lit(None).cast("bigint")})
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        *scope, "n_images", "registered_images", whole("point_count"), whole("observation_count"),
        (F.col("registered_images") / F.col("n_images")).alias("registration"),
        F.coalesce("composition", F.lit(0.0)).alias("composition"),
        F.coalesce("median_support", F.lit(0.0)).alias("median_support"),
        F.coalesce(F.try_divide("point_count", "registered_images"), F.lit(0.0)).alias("points_per_frame"),
        "error_px", F.try_divide(F.col("error_px") * 1000.0, F.when(F.col("focal") > 0, F.col("focal"))).alias("error"),
        F.try_divide("observation_count", "_to").alias("yield_obs"), F.try_divide("point_count", "_tc").alias("yield_track"),
    )


def still_covered(obs: DataFrame, registered: DataFrame, scope: Sequence[str], frame: str, track: str) -> DataFrame:
    """For each frame the share of its tracks that two or more *other* registered frames see."""
    scope = list(scope)
    o = obs.select(*scope, frame, track).dropna().join(registered.select(*scope, frame, F.lit(1).alias("_r")).distinct(), [*scope, frame], "left").withColumn("_r", F.coalesce("_r", F.lit(0)))
    views = o.groupBy(*scope, track).agg(F.sum("_r").alias("_v"))
    return o.join(views, [*scope, track]).groupBy(*scope, frame).agg(F.avg((F.col("_v") - F.col("_r") >= 2).cast("double")).alias("still_covered"))


def lost_and_gained(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys (cameras) on one side only, as ``lost`` or ``gained``."""
    key = list(key)
    a, b = before.select(*key).dropna().distinct(), after.select(*key).dropna().distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("lost")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("gained")))


def paired_error_by_support(a: DataFrame, b: DataFrame, support: DataFrame) -> DataFrame:
    """Error of model a minus b on points that both built from one track, by the support of a's point (2, 3, 4, 5 and more).

    ``a, b(track_id, row, point_idx, error)``; of b's points of one track the last row counts, negative and null tracks are
    none; ``support(point_idx, len)`` of a. Buckets without points have 0 and null.
    """
    last = b.filter("track_id >= 0").groupBy("track_id").agg(F.max_by("error", "row").alias("_eb"))
    j = a.filter("track_id >= 0").join(last, "track_id").join(support, "point_idx", "left")
    d = j.select(F.least(F.coalesce("len", F.lit(0)), F.lit(5)).cast("int").alias("bucket"), (F.col("error") - F.col("_eb")).alias("_d")).filter("NOT isnan(_d) AND abs(_d) < double('inf') AND bucket >= 2")
    buckets = a.sparkSession.range(2, 6).select(F.col("id").cast("int").alias("bucket"))
    n = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("points"))
    return buckets.join(n, "bucket", "left").join(exact_percentiles(d, ["bucket"], "_d", {"median_diff": 0.5}), "bucket", "left").withColumn("points", F.coalesce("points", F.lit(0)))


def centre_agreement(a: DataFrame, b: DataFrame, scope: str = "scope", least: int = 6) -> DataFrame:
    """``scope, median_of_span``: how far a's camera centres lie from b's after the best similarity, as median over the span
    of b's centres. Scopes with fewer than ``least`` common cameras have no row.

    Sums over cameras are taken by Spark; one 3 x 3 decomposition per scope runs on batches of scopes.
    """
    import numpy as np
    import pandas as pd

    both = a.filter("valid").select(scope, "image_idx", *[c.alias(f"a{i}") for i, c in enumerate(g.centre(F.col("pose")))]).join(b.filter("valid").select(scope, "image_idx", *[c.alias(f"b{i}") for i, c in enumerate(g.centre(F.col("pose")))]), [scope, "image_idx"])
    am, bm = [F.avg(f"a{i}").alias(f"ma{i}") for i in range(3)], [F.avg(f"b{i}").alias(f"mb{i}") for i in range(3)]
    cov = [F.covar_pop(f"b{i}", f"a{j}").alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    var = sum((F.var_pop(f"a{i}") for i in range(3)), F.lit(0.0)).alias("var")
    span = F.sqrt(sum((F.pow(F.max(f"b{i}") - F.min(f"b{i}"), 2.0) for i in range(3)), F.lit(0.0))).alias("span")
    sums = both.groupBy(scope).agg(F.count(F.lit(1)).alias("n"), *am, *bm, *cov, var, span).filter(F.col("n") >= least)

    def fit(parts):
        for d in parts:
            m = np.stack([np.stack([d[f"c{i}{j}"] for j in range(3)], 1) for i in range(3)], 1) if len(d) else np.zeros((0, 3, 3))
            u, s, vt = np.linalg.svd(m)
            sign = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
            u[:, :, 2] *= sign[:, None]
            scale = (s[:, 0] + s[:, 1] + sign * s[:, 2]) / np.maximum(d["var"].to_numpy(), 1e-12)
            m = scale[:, None, None] * (u @ vt)
            yield pd.DataFrame({scope: d[scope]} | {f"m{i}{j}": m[:, i, j] for i in range(3) for j in range(3)} | {c: d[c] for c in ("span", *[f"m{x}{i}" for x in "ab" for i in range(3)])})

    names = [*[f"m{i}{j}" for i in range(3) for j in range(3)], "span", *[f"m{x}{i}" for x in "ab" for i in range(3)]]
    got = sums.mapInPandas(fit, f"{scope} {sums.schema[scope].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names))
    r = [sum((F.col(f"m{i}{j}") * (F.col(f"a{j}") - F.col(f"ma{j}")) for j in range(3)), F.lit(0.0)) + F.col(f"mb{i}") - F.col(f"b{i}") for i in range(3)]
    res = both.join(got, scope).select(scope, "span", g.norm(r).alias("_r"))
    return exact_percentiles(res.select(scope, (F.col("_r") / F.greatest("span", F.lit(1e-12))).alias("_r")), [scope], "_r", {"median_of_span": 0.5})


def two_estimators(model: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """``scope, form, versus_one, versus_two, mutual, ratio, fires``: a model's disagreement with two estimators over that
    between them, by rotation and by centre; fires from ``FIRE_LEVEL``, null where the estimators give no spread."""
    out = None
    # angles below 1e-4 degrees are rounding noise of the arc cosine
    for form, measure, c, places in (("rotation", rotation_agreement, "median_deg", 4), ("centre", centre_agreement, "median_of_span", 6)):
        parts = [measure(x, y).select("scope", F.round(c, places).alias(n)) for x, y, n in ((model, one, "versus_one"), (model, two, "versus_two"), (one, two, "mutual"))]
        j = parts[0].join(parts[1], "scope", "full").join(parts[2], "scope", "full").withColumn("form", F.lit(form))
        out = j if out is None else out.unionByName(j)
    n = F.col("versus_one").isNotNull().cast("int") + F.col("versus_two").isNotNull().cast("int")
    mine = F.try_divide(F.coalesce("versus_one", F.lit(0.0)) + F.coalesce("versus_two", F.lit(0.0)), F.when(n > 0, n))
    ratio = F.round(F.try_divide(mine, F.when(F.col("mutual") > 0, F.col("mutual"))), 3)
    return out.withColumn("ratio", ratio).withColumn("fires", F.col("ratio") >= FIRE_LEVEL)


def window_rungs(first: int, images: int) -> list[tuple[int, str]]:
    """Windows a second solve may use, narrowest first: each wider than the one before and no wider than the capture."""
    out, floor = [], first
    for width, role in WINDOWS:
        if min(width, images) > floor:
            floor = min(width, images)
            out.append((floor, role))
    return out


def cloud_summary(df: DataFrame, scope: Sequence[str], x: str, y: str, z: str, percentiles: dict[str, float]) -> DataFrame:
    """Box, centroid and percentiles of the distance from it, by scope. Points that are not finite do not count."""
    scope = list(scope)
    ok = df
    for c in (x, y, z):
        ok = ok.filter(~F.isnan(c) & (F.abs(c) < float("inf")))
    box = ok.groupBy(*scope).agg(F.count(F.lit(1)).alias("points"), *[f(c).alias(f"{n}_{c}") for c in (x, y, z) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    off = ok.join(F.broadcast(box), scope) if not scope else ok.join(box, scope)
    r = off.select(*scope, F.sqrt(sum((F.pow(F.col(c) - F.col(f"mean_{c}"), 2.0) for c in (x, y, z)), F.lit(0.0))).alias("_r"))
    return box.join(exact_percentiles(r, scope, "_r", percentiles), scope)


def normalised_cloud(df: DataFrame, scope: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Points minus their component-wise median, over the 90th percentile of the distance from it."""
    scope, out = list(scope), df
    for c in (x, y, z):
        out = out.join(exact_percentiles(df, scope, c, {f"_m{c}": 0.5}), scope).withColumn(c, F.col(c) - F.col(f"_m{c}")).drop(f"_m{c}")
    r = F.sqrt(sum((F.col(c) * F.col(c) for c in (x, y, z)), F.lit(0.0)))
    p90 = exact_percentiles(out.select(*scope, r.alias("_r")), scope, "_r", {"_p90": 0.9})
    return out.join(p90, scope).withColumns({c: F.try_divide(F.col(c), F.col("_p90")) for c in (x, y, z)}).select(*df.columns)


def series_summary(df: DataFrame, series: Sequence[str], at: str, value: str, whole: int = 200, extremes: int = 8) -> DataFrame:
    """A series for display: n, least, median and greatest, and its ``extremes`` lowest and highest entries with their places;
    a series of ``whole`` entries or fewer is given in full instead, in order. Values to six significant digits; gaps and
    rows with a null key are left out.
    """
    from skerry.operators.records import significant

    series = list(series)
    ok = df.dropna(subset=[*series, at]).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*series, F.col(at).alias("at"), F.col(value).cast("double").alias("v"))
    six = significant(F.col("v")).alias("v")
    n = ok.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    short = ok.join(n.filter(F.col("n") <= whole), series, "left_semi").select(*series, F.struct("at", six).alias("e")).groupBy(*series).agg(F.array_sort(F.collect_list("e")).alias("entries"))
    ends = []
    for name, o in (("lowest", [F.asc("v"), F.asc("at")]), ("highest", [F.desc("v"), F.desc("at")])):
        k = ok.withColumn("_r", F.row_number().over(Window.partitionBy(*series).orderBy(*o))).filter(F.col("_r") <= extremes)
        ends.append(k.select(*series, F.struct("_r", "at", six).alias("e")).groupBy(*series).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["at"].alias("at"), e["v"].alias("v"))).alias(name)))
    out = n.join(exact_percentiles(ok, series, "v", {"_med": 0.5}), series).join(short, series, "left")
    for e in ends:
        out = out.join(e, series, "left")
    long = F.col("n") > whole
    return out.select(*series, "n", *[significant(F.col(c)).alias(x) for c, x in (("_lo", "least"), ("_med", "median"), ("_hi", "greatest"))], "entries", *[F.when(long, F.col(x)).alias(x) for x in ("lowest", "highest")])


def flag_summary(df: DataFrame, scope: Sequence[str], flag: Column, value: str) -> DataFrame:
    """Share of flagged rows, greatest value and 90th percentile, by scope."""
    scope = list(scope)
    t = df.withColumn("_f", flag.cast("double"))
    return t.groupBy(*scope).agg(F.avg("_f").alias("share"), F.max(value).alias("greatest")).join(exact_percentiles(t, scope, value, {"p90": 0.9}), scope, "left")


def resolutions(images: DataFrame, scope: Sequence[str], w: str, h: str, scale: str) -> DataFrame:
    """Distinct sizes, whether they are mixed, and the median scale, by scope."""
    scope = list(scope)
    n = images.groupBy(*scope).agg(F.count_distinct(w, h).alias("sizes"))
    return n.withColumn("mixed", F.col("sizes") > 1).join(exact_percentiles(images, scope, scale, {"median_scale": 0.5}), scope, "left")


def mean_by(df: DataFrame, domain: DataFrame, key: Sequence[str], value: str, out: str = "mean") -> DataFrame:
    """Mean of a value per key of the domain, 0 where it has none; null and NaN values do not count."""
    v = df.filter(~F.isnan(F.col(value).cast("double"))).groupBy(*key).agg(F.avg(value).alias(out))
    return domain.select(*key).dropna().distinct().join(v, list(key), "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def carried(images: DataFrame, mask: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """A flag carried to every image: false where it is missing, left out where there is no image."""
    return images.join(mask.select(*key, flag).dropna().groupBy(*key).agg(F.bool_or(flag).alias(flag)), list(key), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
