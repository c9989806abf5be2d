"""Readings of models and series over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import geometry as g
from skerry.functions.text import tidy
from skerry.operators import aggregates as A
from skerry.operators import geometry as GM
from skerry.operators import graph as G
from skerry.operators import health as H
from skerry.operators import selection as S
from skerry.runtime import table as T

QUERIES: dict = {}
SQL: dict[str, str] = {}

_CAP = "lower(trim(capture, E' \\t\\r\\n'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("$CAP", _CAP)
        return f

    return add


def _r(df: DataFrame, places: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


@query("""WITH x AS (SELECT l_returnflag AS k, l_extendedprice AS b, l_extendedprice * (1 + l_discount) AS a, l_quantity * 1800 AS e FROM lineitem),
y AS (SELECT k, a > e AS gone, CASE WHEN a > e THEN NULL ELSE a END AS a, CASE WHEN b > e THEN NULL ELSE b END AS b FROM x),
z AS (SELECT k, count(*) AS points, count(*) FILTER (gone) AS escaped, avg(b) AS mb, avg(a) AS ma, quantile_cont(b, 0.95) AS pb, quantile_cont(a, 0.95) AS pa FROM y GROUP BY 1)
SELECT k AS l_returnflag, CAST(points AS BIGINT) AS points, CAST(escaped AS BIGINT) AS escaped, round(mb, 4) AS mean_before, round(ma, 4) AS mean_after, round(pb, 4) AS p95_before, round(pa, 4) AS p95_after,
 escaped / points AS escaped_share, escaped = points OR escaped / points >= 0.05 OR coalesce(pa > 1000 * greatest(pb, 0.000001), false) AS diverged FROM z""")
def error_readings(spark: SparkSession, d: str) -> DataFrame:
    l = T(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_extendedprice") * (1 + F.col("l_discount"))).alias("after"), (F.col("l_quantity") * 1800).alias("extent"))
    return _r(H.error_readings(l, ["l_returnflag"], "l_extendedprice", "after", F.col("extent")), 4, "mean_before", "mean_after", "p95_before", "p95_after")


_O = "o AS (SELECT DISTINCT $CAP AS scope, track_id AS t, frame_idx AS f FROM observations WHERE capture IS NOT NULL AND track_id IS NOT NULL AND frame_idx IS NOT NULL)"


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "observations").select(tidy("capture").alias("scope"), F.col("track_id").alias("point_idx"), "frame_idx", "visibility").dropna(subset=["scope", "point_idx", "frame_idx"])


@query("WITH " + _O + """, p AS (SELECT scope, t, CAST(t % 97 AS DOUBLE) / 10 AS e, count(*) AS n FROM o GROUP BY ALL), c AS (SELECT DISTINCT scope, f, f % 5 <> 0 AS v FROM o),
cc AS (SELECT scope, count(*) AS n_images, count(*) FILTER (v) AS reg FROM c GROUP BY 1), raw AS (SELECT $CAP AS scope, count(*) AS m FROM observations WHERE capture IS NOT NULL AND track_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY 1)
SELECT p.scope AS scope, CAST(any_value(n_images) AS BIGINT) AS n_images, CAST(any_value(reg) AS BIGINT) AS registered_images, CAST(count(*) AS BIGINT) AS point_count, CAST(sum(n) AS BIGINT) AS observation_count, any_value(reg) / any_value(n_images) AS registration,
 round(avg(CAST(n >= 3 AS INT)), 6) AS composition, median(n) AS median_support, round(CASE WHEN any_value(reg) > 0 THEN count(*) / any_value(reg) ELSE 0 END, 6) AS points_per_frame, round(median(e) FILTER (n >= 3), 6) AS error_px, round(median(e) FILTER (n >= 3) * 1000 / 800, 6) AS error,
 round(sum(n) / any_value(m), 6) AS yield_obs, CAST(1 AS DOUBLE) AS yield_track FROM p JOIN cc USING (scope) JOIN raw USING (scope) GROUP BY 1""")
def model_components(spark: SparkSession, d: str) -> DataFrame:
    """Readings of every capture, its built tracks taken as a model whose errors come from a rule."""
    o = _obs(spark, d)
    one = o.select("scope", "frame_idx", "point_idx").distinct()
    points = one.select("scope", "point_idx").distinct().withColumn("error", (F.col("point_idx") % 97).cast("double") / 10)
    cams = one.select("scope", F.col("frame_idx").alias("image_idx")).distinct().withColumn("valid", F.col("image_idx") % 5 != 0)
    focal = one.select("scope").distinct().withColumn("focal", F.lit(800.0))
    r = H.components(points, one, cams, ["scope"], focal, o.select("scope", F.col("point_idx").alias("track_id")))
    return _r(r, 6, "composition", "points_per_frame", "error_px", "error", "yield_obs")


@query("WITH " + _O + """, v AS (SELECT scope, t, count(*) FILTER (f % 3 <> 0) AS n FROM o GROUP BY ALL)
SELECT o.scope AS scope, o.f AS frame_idx, round(avg(CAST(n - CASE WHEN f % 3 <> 0 THEN 1 ELSE 0 END >= 2 AS INT)), 6) AS still_covered FROM o JOIN v USING (scope, t) GROUP BY ALL""")
def still_covered(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).select("scope", "frame_idx", "point_idx").distinct()
    return _r(H.still_covered(o, o.filter("frame_idx % 3 <> 0"), ["scope"], "frame_idx", "point_idx"), 6, "still_covered")


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '5%')
SELECT o_custkey, 'lost' AS change FROM a ANTI JOIN b USING (o_custkey) UNION ALL SELECT o_custkey, 'gained' FROM b ANTI JOIN a USING (o_custkey)""")
def lost_and_gained(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders")
    return H.lost_and_gained(o.filter("o_orderpriority LIKE '1%'"), o.filter("o_orderpriority LIKE '5%'"), ["o_custkey"])


@query("""WITH a AS (SELECT l_partkey AS t, l_orderkey AS p, l_discount AS e FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_partkey AS t, arg_max(l_discount, l_orderkey) AS e FROM lineitem WHERE l_linenumber = 2 GROUP BY 1),
s AS (SELECT l_orderkey AS p, count(*) AS len FROM lineitem GROUP BY 1), x AS (SELECT least(len, 5) AS k, a.e - b.e AS diff FROM a JOIN b USING (t) JOIN s USING (p) WHERE len >= 2)
SELECT CAST(k AS INT) AS bucket, CAST(count(diff) AS BIGINT) AS points, round(median(diff), 6) AS median_diff FROM range(2, 6) r(k) LEFT JOIN x USING (k) GROUP BY 1""")
def paired_errors(spark: SparkSession, d: str) -> DataFrame:
    l = T(spark, d, "lineitem")
    m = lambda n: l.filter(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("track_id"), F.col("l_orderkey").alias("row"), F.col("l_orderkey").alias("point_idx"), F.col("l_discount").alias("error"))
    support = l.groupBy(F.col("l_orderkey").alias("point_idx")).agg(F.count(F.lit(1)).alias("len"))
    return _r(H.paired_error_by_support(m(1), m(2), support), 6, "median_diff")


@query("""WITH c AS (SELECT n_regionkey AS scope, n_nationkey AS i, n_nationkey * 0.05 AS a, n_nationkey * 0.05 + 0.003 * (n_nationkey % 4) AS b FROM nation),
p AS (SELECT x.scope, degrees(abs((x.a - y.a) - (x.b - y.b))) AS d FROM c x JOIN c y ON x.scope = y.scope AND x.i < y.i) SELECT scope, round(median(d), 4) AS median_deg, round(quantile_cont(d, 0.9), 4) AS p90_deg FROM p GROUP BY 1""")
def rotation_agreements(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of cameras that turn about one axis at slightly different rates."""
    n = T(spark, d, "nation")

    def turned(a):
        rot = [F.cos(a), F.lit(0.0), F.sin(a), F.lit(0.0), F.lit(1.0), F.lit(0.0), -F.sin(a), F.lit(0.0), F.cos(a)]
        pose = F.struct(*[r.alias(f"r{i // 3}{i % 3}") for i, r in enumerate(rot)], *[F.lit(0.0).alias(f"t{i}") for i in range(3)])
        return n.select(F.col("n_regionkey").alias("scope"), F.col("n_nationkey").alias("image_idx"), pose.alias("pose"), F.lit(True).alias("valid"))

    k = F.col("n_nationkey")
    return _r(GM.rotation_agreement(turned(k * 0.05), turned(k * 0.05 + 0.003 * (k % 4))), 4, "median_deg", "p90_deg")


@query("""WITH c AS (SELECT l_returnflag AS k, count(*) AS points, min(l_quantity) AS a, max(l_quantity) AS b, avg(l_quantity) AS m, min(l_discount) AS a2, max(l_discount) AS b2, avg(l_discount) AS m2, min(l_tax) AS a3, max(l_tax) AS b3, avg(l_tax) AS m3 FROM lineitem GROUP BY 1),
r AS (SELECT k, sqrt((l_quantity - m) ** 2 + (l_discount - m2) ** 2 + (l_tax - m3) ** 2) AS r FROM lineitem JOIN c ON k = l_returnflag)
SELECT c.k AS l_returnflag, CAST(any_value(points) AS BIGINT) AS points, any_value(a) AS min_l_quantity, any_value(b) AS max_l_quantity, round(any_value(m), 6) AS mean_l_quantity, any_value(a2) AS min_l_discount, any_value(b2) AS max_l_discount, round(any_value(m2), 6) AS mean_l_discount,
 any_value(a3) AS min_l_tax, any_value(b3) AS max_l_tax, round(any_value(m3), 6) AS mean_l_tax, round(median(r), 4) AS p50, round(quantile_cont(r, 0.9), 4) AS p90 FROM c JOIN r USING (k) GROUP BY 1""")
def cloud_summary(spark: SparkSession, d: str) -> DataFrame:
    c = H.cloud_summary(T(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount", "l_tax", {"p50": 0.5, "p90": 0.9})
    return _r(_r(c, 6, "mean_l_quantity", "mean_l_discount", "mean_l_tax"), 4, "p50", "p90")


@query("""WITH s AS (SELECT o_orderpriority AS k, count(*) AS n, min(o_totalprice) AS a, max(o_totalprice) AS b, median(o_totalprice) AS m, list(o_orderkey ORDER BY o_totalprice, o_orderkey)[1:8] AS lo, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC)[1:8] AS hi FROM orders GROUP BY 1)
SELECT k AS o_orderpriority, CAST(n AS BIGINT) AS n, round(a, 0) AS least, round(m, 0) AS median, round(b, 0) AS greatest, array_to_string(lo, ',') AS lowest, array_to_string(hi, ',') AS highest FROM s""")
def series(spark: SparkSession, d: str) -> DataFrame:
    """Prices of orders by priority: extremes and where they are (rounded further than the operator's six digits)."""
    s = H.series_summary(T(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice", whole=5)
    at = lambda c: F.array_join(F.transform(c, lambda e: e["at"].cast("string")), ",").alias(c)
    return s.select("o_orderpriority", "n", *[F.round(c, 0).alias(c) for c in ("least", "median", "greatest")], at("lowest"), at("highest"))


@query("""SELECT $CAP AS capture, round(avg(CAST(match_count < 15 AS INT)), 6) AS share, max(match_count) AS greatest, round(quantile_cont(match_count, 0.9), 4) AS p90 FROM pairs WHERE capture IS NOT NULL GROUP BY 1""")
def weak_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "pairs").withColumn("capture", tidy("capture")).filter("capture IS NOT NULL")
    return _r(_r(H.flag_summary(p, ["capture"], F.col("match_count") < 15, "match_count"), 6, "share"), 4, "p90")


@query("""SELECT campaign, CAST(count(DISTINCT (w0, h0)) FILTER (w0 IS NOT NULL AND h0 IS NOT NULL) AS BIGINT) AS sizes, count(DISTINCT (w0, h0)) FILTER (w0 IS NOT NULL AND h0 IS NOT NULL) > 1 AS mixed, round(median(sx), 6) AS median_scale FROM scenes WHERE campaign IS NOT NULL GROUP BY 1""")
def resolutions(spark: SparkSession, d: str) -> DataFrame:
    return _r(H.resolutions(T(spark, d, "scenes").filter("campaign IS NOT NULL"), ["campaign"], "w0", "h0", "sx"), 6, "median_scale")


@query("""SELECT $CAP AS scope, track_id AS point_idx, round(coalesce(avg(visibility) FILTER (NOT isnan(visibility)), 0), 6) AS mean FROM observations WHERE capture IS NOT NULL AND track_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY ALL""")
def mean_visibility(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d)
    return _r(H.mean_by(o, o, ["scope", "point_idx"], "visibility"), 6, "mean")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders), m AS (SELECT DISTINCT c_custkey, c_acctbal > 0 AS flag FROM customer WHERE c_custkey % 4 <> 0) SELECT c_custkey, coalesce(flag, false) AS flag FROM a LEFT JOIN m USING (c_custkey)""")
def carried_flags(spark: SparkSession, d: str) -> DataFrame:
    images = T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return H.carried(images, T(spark, d, "customer").filter("c_custkey % 4 <> 0").select("c_custkey", (F.col("c_acctbal") > 0).alias("flag")), ["c_custkey"], "flag")


@query("""WITH b AS (SELECT l_linestatus AS k, CAST(least(15, floor(l_quantity / 3.2)) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL), h AS (SELECT k, bin, n / sum(n) OVER (PARTITION BY k) AS p FROM b)
SELECT round(sqrt(greatest(0, 1 - sum(sqrt(x.p * y.p)))), 6) AS distance FROM h x JOIN h y ON x.k = 'O' AND y.k = 'F' AND x.bin = y.bin""")
def histogram_distance(spark: SparkSession, d: str) -> DataFrame:
    h = A.histogram(T(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", 0.0, 51.2, 16)
    side = lambda k: h.filter(F.col("l_linestatus") == k)
    return _r(A.histogram_distance(side("O"), side("F")), 6, "distance")


@query("""WITH g AS (SELECT $CAP AS scope, track_id AS t, frame_idx AS f, count(*) AS n FROM observations WHERE capture IS NOT NULL AND track_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY ALL)
SELECT round(avg(CAST(bad AS INT)), 6) AS inconsistent_rate FROM (SELECT scope, t, max(n) > 1 AS bad FROM g GROUP BY ALL)""")
def inconsistent_tracks(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).withColumn("group", F.concat_ws("/", "scope", "point_idx"))
    return _r(G.inconsistent_rate(o, "group", "frame_idx"), 6, "inconsistent_rate")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 4""")
def last_events(spark: SparkSession, d: str) -> DataFrame:
    return S.last_n(T(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 4)


@query("""WITH e AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT least(c.c_nationkey, s.s_nationkey) AS "left", greatest(c.c_nationkey, s.s_nationkey) AS "right", CAST(count(*) AS BIGINT) AS edges
FROM e JOIN customer c ON c_custkey = o_custkey JOIN supplier s ON s_suppkey = l_suppkey WHERE c.c_nationkey <> s.s_nationkey GROUP BY ALL""")
def bridges(spark: SparkSession, d: str) -> DataFrame:
    """Trade between customers and suppliers of different nations, as edges across labels."""
    e = T(spark, d, "orders").join(T(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + (1 << 40)).alias("dst")).distinct()
    labels = T(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("component")).unionByName(T(spark, d, "supplier").select((F.col("s_suppkey") + (1 << 40)).alias("node"), F.col("s_nationkey").alias("component")))
    return G.bridges_between(e, labels, "src", "dst")


@query("""SELECT n_nationkey AS image_idx, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 5 ELSE 0 END AS k FROM nation""")
def intrinsics_of_images(spark: SparkSession, d: str) -> DataFrame:
    """Images with a camera number of their own, and others, which take the first camera (there are fewer cameras than images)."""
    images = T(spark, d, "nation").select(F.col("n_nationkey").alias("image_idx"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 5).alias("camera_idx"))
    return GM.per_image_intrinsics(images, T(spark, d, "region").select(F.col("r_regionkey").alias("camera_idx"), F.col("r_regionkey").alias("k")))


@query("""SELECT n_nationkey AS image_idx, n_nationkey AS pose, false AS filled FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, n_nationkey + 100, true FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 0""")
def filled_poses(spark: SparkSession, d: str) -> DataFrame:
    n = T(spark, d, "nation")
    side = lambda add, ok: n.select(F.col("n_nationkey").alias("image_idx"), (F.col("n_nationkey") + add).alias("pose"), F.expr(ok).alias("valid"))
    return GM.fill_poses(side(0, "n_nationkey % 3 <> 0"), side(100, "n_nationkey % 2 = 0"))


@query("""SELECT capture, w0, h0, greatest(1, CAST(round_even(w0 * least(1.0, 1024.0 / greatest(w0, h0)), 0) AS INT)) AS w, greatest(1, CAST(round_even(h0 * least(1.0, 1024.0 / greatest(w0, h0)), 0) AS INT)) AS h FROM (SELECT DISTINCT capture, w0, h0 FROM scenes WHERE w0 IS NOT NULL AND h0 IS NOT NULL)""")
def fitted_sizes(spark: SparkSession, d: str) -> DataFrame:
    w, h = g.fit_size(F.col("w0"), F.col("h0"), 1024)
    return T(spark, d, "scenes").select("capture", "w0", "h0").dropna(subset=["w0", "h0"]).distinct().select("capture", "w0", "h0", w.alias("w"), h.alias("h"))


@query("""SELECT CASE WHEN c_acctbal IS NULL OR isnan(c_acctbal) OR c_nationkey % 5 = 0 THEN 'unknown' WHEN (c_nationkey % 5 = 1 OR c_acctbal >= 0) AND c_acctbal <= 5000 THEN 'good' ELSE 'warning' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1""")
def metric_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Balances held against bands that are closed, open below, or absent."""
    band = F.col("c_nationkey") % 5
    lo, hi = F.when(band > 1, F.lit(0.0)), F.when(band > 0, F.lit(5000.0))
    return T(spark, d, "customer").groupBy(g.health(F.col("c_acctbal"), F.lit("higher"), lo, hi).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT l_returnflag AS k, l_linenumber AS f, max(l_extendedprice) AS e FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f) AS r FROM f), t AS (SELECT k, arg_max(r, (e, -r)) AS top FROM r GROUP BY 1)
SELECT r.k AS l_returnflag, r.f AS frame_idx, r.e AS error FROM r JOIN t USING (k) WHERE abs(r - top) <= 2""")
def worst_windows(spark: SparkSession, d: str) -> DataFrame:
    l = T(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("frame_idx"), F.col("l_extendedprice").alias("error"))
    return GM.worst_frames(l, 2, ["l_returnflag"])


@query("""SELECT CAST(floor(l_quantity) AS BIGINT) AS px, CAST(floor(l_discount * 100) AS BIGINT) AS py, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS colour, min(l_extendedprice) AS depth FROM lineitem GROUP BY 1, 2""")
def depth_buffer(spark: SparkSession, d: str) -> DataFrame:
    l = T(spark, d, "lineitem").select(F.floor("l_quantity").alias("px"), F.floor(F.col("l_discount") * 100).alias("py"), F.col("l_extendedprice").alias("depth"), F.col("l_orderkey").alias("colour"))
    return GM.depth_views(l, "px", "py", "depth", "colour")
