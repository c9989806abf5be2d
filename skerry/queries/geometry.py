"""Geometry over closed-form scenes built from the driver's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import geometry as g
from skerry.operators import geometry as G
from skerry.runtime import table as T
from skerry.streaming.events import windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _scene(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cameras on an arc (nations), points in front of it (parts), each point seen by the cameras of its residue."""
    a = F.col("n_nationkey") * 0.05
    rot = [F.cos(a), F.lit(0.0), F.sin(a), F.lit(0.0), F.lit(1.0), F.lit(0.0), -F.sin(a), F.lit(0.0), F.cos(a)]
    c = [2.5 * F.sin(a), F.lit(0.0), 6 - 6 * F.cos(a)]
    t = [-(rot[3 * i] * c[0] + rot[3 * i + 1] * c[1] + rot[3 * i + 2] * c[2]) for i in range(3)]
    pose = F.struct(*[r.alias(f"r{i // 3}{i % 3}") for i, r in enumerate(rot)], *[x.alias(f"t{i}") for i, x in enumerate(t)])
    poses = T(spark, d, "nation").select(F.col("n_nationkey").alias("image_idx"), pose.alias("pose"), F.lit(True).alias("valid"))
    k = F.col("p_partkey")
    points = T(spark, d, "part").select(k.alias("point_idx"), F.sin(k).alias("x"), F.cos(k * 2).alias("y"), (6 + F.sin(k * 3)).alias("z"), F.abs(F.sin(k)).alias("error"))
    obs = points.select("point_idx", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("frame_idx")).filter("(point_idx + frame_idx) % 5 < 2")
    return poses, points, obs


def _seen(poses: DataFrame, points: DataFrame, obs: DataFrame) -> DataFrame:
    """Each observation with its point and pose. Points are not broadcast: their table is far larger than the file that Spark judges
    it by."""
    return obs.join(points.hint("merge"), "point_idx").join(F.broadcast(poses.withColumnRenamed("image_idx", "frame_idx")), "frame_idx")  # 25 cameras


_SCENE = """WITH cam AS (SELECT n_nationkey AS f, cos(n_nationkey * 0.05) AS c, sin(n_nationkey * 0.05) AS s FROM nation),
pt AS (SELECT p_partkey AS p, sin(p_partkey) AS x, cos(p_partkey * 2) AS y, 6 + sin(p_partkey * 3) AS z, abs(sin(p_partkey)) AS error FROM part),
ob AS (SELECT p, f, x, y, z, error, c, s, 2.5 * s AS ox, 6 - 6 * c AS oz FROM pt, cam WHERE (p + f) % 5 < 2),
"""


@query(_SCENE + "r AS (SELECT *, c * (x - ox) + s * (z - oz) AS u, y AS v, -s * (x - ox) + c * (z - oz) AS w FROM ob) SELECT f AS frame_idx, CAST(count(*) AS BIGINT) AS n, round(avg(900 * u / w + 512), 3) AS u, round(avg(900 * v / w + 384), 3) AS v FROM r GROUP BY 1")
def reprojection(spark: SparkSession, d: str) -> DataFrame:
    poses, points, obs = _scene(spark, d)
    j = _seen(poses, points, obs)
    k = F.struct(F.lit(900.0).alias("fx"), F.lit(900.0).alias("fy"), F.lit(512.0).alias("cx"), F.lit(384.0).alias("cy"))
    u, v, _ = g.project(F.col("pose"), k, (F.col("x"), F.col("y"), F.col("z")))
    return j.select("frame_idx", u.alias("u"), v.alias("v")).groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("u"), 3).alias("u"), F.round(F.avg("v"), 3).alias("v"))


_ANGLE = _SCENE + """a AS (SELECT m.p AS p, max(degrees(acos(least(1, greatest(-1, ((m.ox - m.x) * (n.ox - m.x) + m.y * m.y + (m.oz - m.z) * (n.oz - m.z)) /
 (sqrt((m.ox - m.x) ** 2 + m.y ** 2 + (m.oz - m.z) ** 2) * sqrt((n.ox - m.x) ** 2 + m.y ** 2 + (n.oz - m.z) ** 2))))))) AS angle FROM ob m JOIN ob n ON m.p = n.p AND m.f < n.f GROUP BY 1)"""


@query(_ANGLE + " SELECT p AS point_idx, round(angle, 4) AS angle FROM a")
def widest_angle(spark: SparkSession, d: str) -> DataFrame:
    poses, points, obs = _scene(spark, d)
    return G.widest_angles(obs, points, poses).withColumn("angle", F.round("angle", 4))


@query(_ANGLE + """ SELECT (SELECT min(n) FROM (SELECT count(*) AS n FROM ob GROUP BY f)) AS min_points, (SELECT round(avg(CAST(n = 2 AS INT)), 6) FROM (SELECT count(*) AS n FROM ob GROUP BY p)) AS two_view_share,
 (SELECT round(quantile_cont(error, 0.95), 6) FROM pt) AS error_p95, round(quantile_cont(angle, 0.05), 4) AS angle_p05, round(median(angle), 4) AS angle_median FROM a""")
def structure_readings(spark: SparkSession, d: str) -> DataFrame:
    poses, points, obs = _scene(spark, d)
    r = G.structure_readings(points, obs, poses)
    return r.withColumns({c: F.round(c, 6) for c in ("two_view_share", "error_p95")} | {c: F.round(c, 4) for c in ("angle_p05", "angle_median")})


@query("SELECT p_partkey AS point_idx, round(sin(p_partkey), 4) + 0 AS x, round(cos(p_partkey * 2), 4) + 0 AS y, round(6 + sin(p_partkey * 3), 4) + 0 AS z, CAST(10 AS BIGINT) AS views FROM part")
def triangulation(spark: SparkSession, d: str) -> DataFrame:
    poses, points, obs = _scene(spark, d)
    j = _seen(poses, points, obs)
    cx, cy, z = g.to_camera(F.col("pose"), (F.col("x"), F.col("y"), F.col("z")))
    t = G.triangulate(j.select("point_idx", "pose", (cx / z).alias("u"), (cy / z).alias("v")))
    return t.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in "xyz"})


@query("""WITH m AS (SELECT l_orderkey % 1000000007 AS k, l_extendedprice / 100 AS a, l_quantity AS b, l_extendedprice / 101 AS c, l_quantity + l_discount AS e FROM lineitem),
s AS (SELECT (c * (0.1 * b + 0.2) + e * (-0.1 * a + 0.3) + (-0.2 * a - 0.3 * b)) AS r, 0.1 * b + 0.2 AS fx, -0.1 * a + 0.3 AS fy, -0.1 * e - 0.2 AS gx, 0.1 * c - 0.3 AS gy FROM m)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(r * r / (fx * fx + fy * fy + gx * gx + gy * gy)), 4) AS sampson FROM s""")
def sampson(spark: SparkSession, d: str) -> DataFrame:
    f = [F.lit(x) for x in (0.0, 0.1, 0.2, -0.1, 0.0, 0.3, -0.2, -0.3, 0.0)]
    l = T(spark, d, "lineitem")
    e = g.sampson(f, (F.col("l_extendedprice") / 100, F.col("l_quantity")), (F.col("l_extendedprice") / 101, F.col("l_quantity") + F.col("l_discount")))
    return l.select(e.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 4).alias("sampson"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    w = windowed_counts(T(spark, d, "events"), "ts", "event_type")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
