"""Proximity joins by grid cells instead of all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators.graph import connected_components
from skerry.runtime import Scratch


def _cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Cells a trifle wider than the reach, so that rounding never puts partners at exactly that distance two cells apart."""
    size *= 1 + 1e-6
    return df.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))


def _around(df: DataFrame) -> DataFrame:
    """Each row in its own and the eight neighbouring cells."""
    near = F.array(*[F.struct((F.col("_cx") + i).alias("_cx"), (F.col("_cy") + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_n", F.explode(near)).withColumn("_cx", F.col("_n._cx")).withColumn("_cy", F.col("_n._cy")).drop("_n")


def band_pairs(df: DataFrame, frame: Sequence[str], item: str, x: str, y: str, tol: float) -> DataFrame:
    """(frame, a, b), a < b: items of a frame within ``tol`` in both axes. Cells are ``tol`` wide, so partners lie next door."""
    frame = list(frame)
    c = _cells(df.select(*frame, item, x, y), x, y, tol)
    right = c.select(*frame, "_cx", "_cy", F.col(item).alias("_b"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    j = _around(c).join(right, [*frame, "_cx", "_cy"])
    return j.filter((F.col(item) < F.col("_b")) & (F.abs(F.col(x) - F.col("_x")) <= tol) & (F.abs(F.col(y) - F.col("_y")) <= tol)).select(*frame, F.col(item).alias("a"), F.col("_b").alias("b"))


def split_rate(obs: DataFrame, track: str, frame: str, x: str, y: str, tol: float, shared: int = 2, track_count: int | None = None) -> DataFrame:
    """How many tracks repeat others: tracks that coincide in ``shared`` frames or more are one, ``(n - merged groups) / n``.

    One row: ``tracks, merged, split_rate``; 0 for one track or none, or without tolerance.
    """
    s = Scratch(obs.sparkSession)
    o = s.write(obs.select(F.col(track).alias("track"), F.col(frame).alias("frame"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna())
    names = o.df.select("track").distinct()
    n = track_count if track_count is not None else names.count()
    one = obs.sparkSession.range(1)
    if n <= 1 or tol <= 0:
        return one.select(F.lit(n).cast("bigint").alias("tracks"), F.lit(0).cast("bigint").alias("merged"), F.lit(0.0).alias("split_rate"))
    e = band_pairs(o.df, ["frame"], "track", "x", "y", tol).distinct().groupBy("a", "b").agg(F.count_distinct("frame").alias("f")).filter(F.col("f") >= shared)
    lab = connected_components(e.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    merged = lab.agg((F.count(F.lit(1)) - F.count_distinct("component")).alias("merged"))
    return merged.select(F.lit(n).cast("bigint").alias("tracks"), "merged", (F.col("merged") / n).alias("split_rate"))


def nearest_within(queries: DataFrame, points: DataFrame, frame: Sequence[str], qid: str, pid: str, x: str, y: str, radius: float) -> DataFrame:
    """``qid, nearest, distance`` of every query: the nearest point of its frame within ``radius`` (ties: smaller id), or null."""
    frame = list(frame)
    q = _around(_cells(queries.select(*frame, qid, x, y), x, y, radius))
    p = _cells(points.select(*frame, F.col(pid).alias("_p"), F.col(x).alias("_x"), F.col(y).alias("_y")), "_x", "_y", radius)
    d = F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))
    near = q.join(p, [*frame, "_cx", "_cy"]).withColumn("_d", d).filter(F.col("_d") <= radius)
    best = near.groupBy(qid).agg(F.min_by("_p", F.struct("_d", "_p")).alias("nearest"), F.min("_d").alias("distance"))
    return queries.select(qid).join(best, qid, "left")


def proximity_edges(df: DataFrame, frame: Sequence[str], item: str, x: str, y: str, eps: float) -> DataFrame:
    """Edges that link items in a common cell of one of four grids of side ``eps``, shifted by half a side, chained within a
    cell (one fewer than members).

    Items within half of ``eps`` of each other in both axes always share a cell in one of the four grids.
    """
    from pyspark.sql import Window

    frame = list(frame)
    grids = F.explode(F.array(*[F.struct(F.lit(k).alias("g"), F.floor(F.col(x) / eps + a).alias("cx"), F.floor(F.col(y) / eps + b).alias("cy")) for k, (a, b) in enumerate([(0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)])]))
    c = df.select(*frame, item, grids.alias("c")).select(*frame, item, "c.*")
    w = Window.partitionBy(*frame, "g", "cx", "cy").orderBy(item)
    return c.select(*frame, F.col(item).alias("src"), F.lead(item).over(w).alias("dst")).filter("dst IS NOT NULL AND src <> dst").distinct()
