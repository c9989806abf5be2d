"""Matching, grids and graphs over the driver's tables, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import tidy
from skerry.operators import graph as G
from skerry.operators import grid as R
from skerry.operators import matching as M
from skerry.runtime import table as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KNN = """WITH a AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS q, b.vec_id AS t, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS d FROM a JOIN a b ON a.label % 2 = 0 AND b.label % 2 = 1 {how}),
"""


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = T(spark, d, "embeddings")
    return e.filter("label % 2 = 0"), e.filter("label % 2 = 1")


@query(_KNN.format(how="") + """r AS (SELECT q, t, d, row_number() OVER (PARTITION BY q ORDER BY d, t) AS k FROM p)
SELECT a.q AS vec_id, a.t AS t1, round(a.d, 5) AS d1, round(b.d, 5) AS d2 FROM r a JOIN r b ON a.q = b.q AND a.k = 1 AND b.k = 2 WHERE a.d < 0.97 * b.d AND b.d > 0""")
def knn_ratio_match(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    m = M.ratio_matches(M.knn2(a, b, "vec_id", "vec_id", "embedding"), 0.97)
    return m.select("vec_id", "t1", F.round("d1", 5).alias("d1"), F.round("d2", 5).alias("d2"))


@query(_KNN.format(how="") + """f AS (SELECT q, arg_min(t, (d, t)) AS t FROM p GROUP BY q), b AS (SELECT t, arg_min(q, (d, q)) AS q FROM p GROUP BY t) SELECT q, t FROM f JOIN b USING (q, t)""")
def mutual_match(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    f = M.knn2(a, b, "vec_id", "vec_id", "embedding").select(F.col("vec_id").alias("q"), F.col("t1").alias("t"))
    g = M.knn2(b, a, "vec_id", "vec_id", "embedding").select(F.col("t1").alias("q"), F.col("vec_id").alias("t"))
    return M.mutual(f, g, "q", "t")


@query()
def cell_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Queries are all vectors whose id is divisible by 20, against all vectors."""
    e = T(spark, d, "embeddings")
    return M.cell_nearest(e, e.filter("vec_id % 20 = 0"), "vec_id", "vec_id", "embedding")


_IMAGES = "s AS (SELECT lower(trim(capture, E' \\t\\r\\n')) AS capture, max(n_images) AS n FROM scenes WHERE capture IS NOT NULL AND n_images IS NOT NULL GROUP BY 1)"


def _images(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "scenes").groupBy(tidy("capture").alias("capture")).agg(F.max("n_images").alias("n")).dropna()


@query("WITH " + _IMAGES + """, f AS (SELECT capture, n, unnest(range(n)) AS i FROM s) SELECT f.capture AS capture, f.i AS i, f.i + k AS j FROM f, range(1, 4) t(k) WHERE f.i + k < n""")
def view_graph_band(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of images of every capture, at most 3 apart."""
    return M.band_pairs(_images(spark, d), "n", ["capture"], 3)


@query("WITH " + _IMAGES + """, f AS (SELECT capture, n, unnest(range(n)) AS i FROM s), p AS (SELECT f.capture, f.i, unnest(range(f.i + 1, n)) AS j FROM f)
SELECT capture, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(i * 31 + j) AS BIGINT) AS mark FROM p GROUP BY 1""")
def view_graph_all(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of images of every capture, counted."""
    p = M.band_pairs(_images(spark, d), "n", ["capture"])
    return p.groupBy("capture").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("i") * 31 + F.col("j")).alias("mark"))


@query("WITH " + _IMAGES + """, c AS (SELECT capture, n - 4 AS n FROM s WHERE n > 4), k AS (SELECT DISTINCT capture, CASE WHEN n <= 10 THEN i ELSE CAST(floor(i * ((n - 1) / 9)) AS BIGINT) END AS i FROM c, range(0, 10) t(i) WHERE n > 10 OR i < n)
SELECT capture, i, i + 4 AS j FROM k""")
def stride_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of images 4 apart, ten at even steps in each capture."""
    return M.stride_pairs(_images(spark, d), "n", 4, ["capture"], 10)


def _links(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "pairs").select("pair_idx", tidy("capture").alias("scope"), "image_i", "image_j").dropna().distinct()
    return T(spark, d, "matches").select("match_idx", "pair_idx", "feature_i", "feature_j", "x1", "y1", "x2", "y2", "confidence").join(p, "pair_idx")


_LINKS = """p AS (SELECT DISTINCT pair_idx, lower(trim(capture, E' \\t\\r\\n')) AS scope, image_i, image_j FROM pairs),
m AS (SELECT DISTINCT scope, image_i, feature_i, image_j, feature_j FROM matches JOIN p USING (pair_idx) WHERE feature_i IS NOT NULL AND feature_j IS NOT NULL),
e AS (SELECT scope, image_i AS i, feature_i AS f, image_j AS i2, feature_j AS f2 FROM m UNION SELECT scope, image_j, feature_j, image_i, feature_i FROM m),
r AS (SELECT DISTINCT scope, i, f, i AS gi, f AS gf FROM e UNION SELECT r.scope, e.i2, e.f2, r.gi, r.gf FROM r JOIN e ON e.scope = r.scope AND e.i = r.i AND e.f = r.f WHERE (r.gi, r.gf) < (e.i2, e.f2)),
g AS (SELECT scope, i, f, min((gi, gf)) AS g FROM r GROUP BY ALL)"""


@query("WITH RECURSIVE " + _LINKS + """, s AS (SELECT scope, g, count(*) AS len, count(*) > count(DISTINCT i) AS bad FROM g GROUP BY ALL)
SELECT scope, CAST(count(*) FILTER (NOT bad AND len >= 2) AS BIGINT) AS tracks, CAST(coalesce(sum(len) FILTER (NOT bad AND len >= 2), 0) AS BIGINT) AS observations FROM s GROUP BY scope HAVING tracks > 0""")
def track_build_drop(spark: SparkSession, d: str) -> DataFrame:
    t = G.build_tracks(_links(spark, d), "drop", 2)
    return t.groupBy("scope").agg(F.count_distinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("observations"))


@query("WITH RECURSIVE " + _LINKS + """, s AS (SELECT scope, g, count(DISTINCT i) AS len FROM g GROUP BY ALL)
SELECT scope, CAST(count(*) AS BIGINT) AS tracks, CAST(sum(len) AS BIGINT) AS observations FROM s WHERE len >= 3 GROUP BY scope""")
def track_build_first(spark: SparkSession, d: str) -> DataFrame:
    t = G.build_tracks(_links(spark, d), "first", 3)
    return t.groupBy("scope").agg(F.count_distinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("observations"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey + 1000000000 AS a, l_suppkey AS b FROM lineitem), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS c FROM n UNION SELECT n.b, r.c FROM r JOIN n ON n.a = r.node WHERE r.c < n.b), g AS (SELECT node, min(c) AS c FROM r GROUP BY 1), s AS (SELECT count(*) AS size FROM g GROUP BY c)
SELECT CAST(size AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS components FROM s GROUP BY 1""")
def components_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "lineitem").select((F.col("l_orderkey") + 1000000000).alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return G.component_sizes(G.connected_components(e)).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


@query("""WITH RECURSIVE o AS (SELECT DISTINCT user_id AS t, CAST(ts AS DATE) AS f, value AS x, CAST(0.3 AS DOUBLE) * hour(ts) AS y FROM events WHERE value IS NOT NULL),
q AS (SELECT a.t AS a, b.t AS b FROM o a JOIN o b ON a.f = b.f AND a.t < b.t AND abs(a.x - b.x) <= CAST(0.3 AS DOUBLE) AND abs(a.y - b.y) <= CAST(0.3 AS DOUBLE) GROUP BY 1, 2 HAVING count(DISTINCT a.f) >= 2),
e AS (SELECT a, b FROM q UNION SELECT b, a FROM q), r AS (SELECT a AS n, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n WHERE r.c < e.b), g AS (SELECT n, min(c) AS c FROM r GROUP BY 1)
SELECT CAST((SELECT count(DISTINCT t) FROM o) AS BIGINT) AS tracks, CAST(count(*) - count(DISTINCT c) AS BIGINT) AS merged, round((count(*) - count(DISTINCT c)) / (SELECT count(DISTINCT t) FROM o), 6) AS split_rate FROM g""")
def split_rate(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "events").select("user_id", F.to_date("ts").alias("f"), "value", (F.lit(0.3) * F.hour("ts")).alias("y"))
    return R.split_rate(o, "user_id", "f", "value", "y", 0.3).withColumn("split_rate", F.round("split_rate", 6))


@query("""WITH g AS (SELECT l_returnflag AS f, l_partkey AS id, floor(l_extendedprice / 100 / 2 + a) AS cx, floor(l_quantity / 2 + b) AS cy, a, b FROM lineitem, (VALUES (CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)), (0.5, 0), (0, 0.5), (0.5, 0.5)) t(a, b)),
e AS (SELECT f, id AS src, lead(id) OVER (PARTITION BY f, a, b, cx, cy ORDER BY id) AS dst FROM g)
SELECT DISTINCT f, src, dst FROM e WHERE dst IS NOT NULL AND src <> dst""")
def proximity_edges(spark: SparkSession, d: str) -> DataFrame:
    l = T(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("id"), (F.col("l_extendedprice") / 100).alias("x"), F.col("l_quantity").alias("y"))
    return R.proximity_edges(l, ["f"], "id", "x", "y", 2.0)


@query("""WITH q AS (SELECT event_id, event_type, value AS x, epoch(ts) / 3600.0 AS y FROM events WHERE value IS NOT NULL),
p AS (SELECT event_type, event_id AS pid, value + 0.11 AS x, epoch(ts) / 3600.0 + 0.07 AS y FROM events WHERE value IS NOT NULL),
n AS (SELECT q.event_id, arg_min(pid, (sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)), pid)) AS nearest FROM q JOIN p ON p.event_type = q.event_type AND abs(q.x - p.x) <= 2 AND abs(q.y - p.y) <= 2
 WHERE sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) <= 2 GROUP BY 1)
SELECT q.event_id AS event_id, nearest FROM q LEFT JOIN n USING (event_id)""")
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events").filter("value IS NOT NULL").select("event_id", "event_type", F.col("value").alias("x"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)") / 3.6e9).alias("y"))
    p = e.select("event_type", F.col("event_id").alias("pid"), (F.col("x") + 0.11).alias("x"), (F.col("y") + 0.07).alias("y"))
    return R.nearest_within(e, p, ["event_type"], "event_id", "pid", "x", "y", 2.0).select("event_id", "nearest")


@query("""WITH p AS (SELECT DISTINCT pair_idx, lower(trim(capture, E' \\t\\r\\n')) AS scope, image_i AS i, image_j AS j FROM pairs),
m AS (SELECT scope, match_idx AS seq, i, j, feature_i AS fi, feature_j AS fj, x1, y1, x2, y2 FROM matches JOIN p USING (pair_idx) WHERE feature_i IS NOT NULL AND feature_j IS NOT NULL),
b AS (SELECT scope, seq, i, j, fi, fj, x2 AS x, y2 AS y FROM m UNION ALL SELECT scope, seq, j, i, fj, fi, x1, y1 FROM m),
l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY scope, i, j, fi ORDER BY seq DESC, fj DESC) = 1),
c AS (SELECT sqrt((y.x - z.x) ** 2 + (y.y - z.y) ** 2) AS off, y.fj <> z.fj AS other FROM l x JOIN l y ON y.scope = x.scope AND y.i = x.j AND y.fi = x.fj JOIN l z ON z.scope = x.scope AND z.i = x.i AND z.j = y.j AND z.fi = x.fi
 WHERE (x.i < x.j AND x.j < y.j) OR (y.j < x.i AND x.i < x.j) OR (x.j < y.j AND y.j < x.i))
SELECT CAST(count(*) AS BIGINT) AS chains, CAST(count(*) FILTER (other AND off >= 40) AS BIGINT) AS merged, CAST(count(*) FILTER (other AND off <= 2) AS BIGINT) AS split,
 CASE WHEN count(*) > 0 THEN round(count(*) FILTER (other AND off >= 40) / count(*), 8) END AS merge_rate, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (other AND off <= 2) / count(*), 8) END AS split_rate FROM c""")
def cycle_rates(spark: SparkSession, d: str) -> DataFrame:
    m = _links(spark, d)
    return G.cycle_rates(m.select("scope", F.col("match_idx").alias("seq"), F.col("image_i").alias("i"), F.col("image_j").alias("j"), F.col("feature_i").alias("fi"), F.col("feature_j").alias("fj"), *[F.col(c).cast("double").alias(n) for c, n in (("x1", "xi"), ("y1", "yi"), ("x2", "xj"), ("y2", "yj"))])).withColumns({c: F.round(c, 8) for c in ("merge_rate", "split_rate")})


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS c, o_orderkey // 2 AS p FROM orders WHERE o_orderkey > 0),
a AS (SELECT c AS start, p AS ancestor, 1 AS depth FROM e UNION SELECT a.start, e.p, a.depth + 1 FROM a JOIN e ON e.c = a.ancestor)
SELECT ancestor, CAST(count(*) AS BIGINT) AS below, CAST(max(depth) AS INT) AS deepest FROM a GROUP BY 1""")
def ancestry(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey div 2").alias("parent"))
    a = G.ancestry(o.filter("o_orderkey > 0"), "o_orderkey", "parent", o, "o_orderkey")
    return a.groupBy("ancestor").agg(F.count(F.lit(1)).alias("below"), F.max("depth").alias("deepest"))


@query("""SELECT o_orderkey FROM orders ANTI JOIN (SELECT o_orderkey // 2 AS o_orderkey FROM orders WHERE o_orderkey > 0) USING (o_orderkey)""")
def leaves(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").select("o_orderkey")
    return G.leaves(o, o.filter("o_orderkey > 0").select(F.expr("o_orderkey div 2").alias("o_orderkey")), "o_orderkey")


_STEPS = "s AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY run_id, step_index ORDER BY saved_at DESC) = 1)"


@query("WITH " + _STEPS + """, a AS (SELECT capture, module, min(module_version) AS v FROM s WHERE status = 'ok' AND capture IS NOT NULL GROUP BY ALL), b AS (SELECT capture, module, min(module_version) AS v FROM s WHERE status = 'failed' AND capture IS NOT NULL GROUP BY ALL)
SELECT coalesce(a.capture, b.capture) AS capture, coalesce(a.module, b.module) AS module, a.v AS left_item, b.v AS right_item FROM a FULL JOIN b ON a.capture = b.capture AND a.module = b.module WHERE a.v IS DISTINCT FROM b.v""")
def lineage_diverge(spark: SparkSession, d: str) -> DataFrame:
    from skerry.plans.skew import latest

    s = latest(T(spark, d, "steps").select("run_id", "step_index", "saved_at", "status", "capture", "module", "module_version"), ["run_id", "step_index"], "saved_at", ["status", "capture", "module", "module_version"])
    side = lambda x: s.filter((F.col("status") == x) & F.col("capture").isNotNull()).groupBy("capture", "module").agg(F.min("module_version").alias("v"))
    return G.diverge(side("ok"), side("failed"), ["capture", "module"], "v")


@query("""WITH d AS (SELECT image, count(*) AS degree FROM (SELECT l_partkey AS image FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) GROUP BY 1) SELECT p_partkey AS l_partkey, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM part LEFT JOIN d ON image = p_partkey""")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") + (1 << 40)).alias("s")).distinct()
    return G.degrees(e, "l_partkey", "s", T(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")


@query("""SELECT CAST(round_even(l_extendedprice / 1000, 0) AS BIGINT) AS cx, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS cy, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def quantize_cells(spark: SparkSession, d: str) -> DataFrame:
    l = T(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_quantity") / 4).alias("y"))
    return M.quantize(l, "x", "y", 1.0).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query()
def greedy_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    m = _links(spark, d).select("pair_idx", "match_idx", "feature_i", "feature_j", "confidence").dropna(subset=["feature_i", "feature_j"]).dropDuplicates(["match_idx"])
    conf = F.coalesce(F.nanvl("confidence", F.lit(-1.0)), F.lit(-1.0))
    return M.greedy_one_to_one(m, "pair_idx", "feature_i", "feature_j", [-conf, F.col("match_idx")]).filter("why = 'kept'").select("pair_idx", "match_idx")
