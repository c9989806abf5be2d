"""Filters, joins and lookups over the domain's tables, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import tidy
from skerry.operators import records as R
from skerry.operators import selection as S
from skerry.plans.skew import hot_keys, latest, skew_join
from skerry.runtime import Scratch
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


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches with their pair, in one row each: the smallest of repeated rows."""
    m = T(spark, d, "matches").filter("match_idx IS NOT NULL").select("match_idx", "pair_idx", "feature_i", "feature_j", "confidence", "x1", "y1", "x2", "y2")
    p = T(spark, d, "pairs").select("pair_idx", tidy("capture").alias("scope"), "image_i", "image_j")
    return R.with_pairs(m, p)


_M = """p AS (SELECT pair_idx, min({'a': $CAP, 'b': image_i, 'c': image_j}) AS v FROM pairs WHERE pair_idx IS NOT NULL GROUP BY 1),
m AS (SELECT m.* EXCLUDE (capture), v.a AS scope, v.b AS image_i, v.c AS image_j FROM matches m LEFT JOIN p USING (pair_idx) WHERE match_idx IS NOT NULL)"""


@query("WITH " + _M + " SELECT scope, CAST(count(*) AS BIGINT) AS matches, CAST(count(confidence) FILTER (confidence >= 0.5 AND NOT isnan(confidence)) AS BIGINT) AS sure FROM m GROUP BY 1")
def confident_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches by capture of their pair (null: pair not on record), and those of confidence 0.5 or more."""
    m = Scratch(spark).write(_matches(spark, d)).df
    sure = R.at_least(m, "confidence", 0.5).groupBy("scope").agg(F.count(F.lit(1)).alias("sure"))
    j = m.groupBy("scope").agg(F.count(F.lit(1)).alias("matches")).alias("a").join(sure.alias("b"), F.col("a.scope").eqNullSafe(F.col("b.scope")), "left")
    return j.select("a.scope", "matches", F.coalesce("sure", F.lit(0)).alias("sure"))


@query("WITH " + _M + """, s AS (SELECT $CAP AS scope, max(w) AS w, max(h) AS h FROM scenes WHERE capture IS NOT NULL GROUP BY 1)
SELECT scope, CAST(count(*) AS BIGINT) AS inside FROM m JOIN s USING (scope) WHERE x1 >= 0 AND y1 >= 0 AND x1 < w AND y1 < h GROUP BY 1""")
def matches_inside(spark: SparkSession, d: str) -> DataFrame:
    """Matches by capture whose first end lies within the image."""
    m = Scratch(spark).write(_matches(spark, d).filter("scope IS NOT NULL").select("scope", "x1", "y1"))
    size = T(spark, d, "scenes").groupBy(tidy("capture").alias("scope")).agg(F.max("w").alias("w"), F.max("h").alias("h")).dropna(subset=["scope"])
    j = skew_join(m.df, size, ["scope"], "inner", hot_keys(m.df, ["scope"], m.rows))
    return R.inside_image(j, "x1", "y1", "w", "h").groupBy("scope").agg(F.count(F.lit(1)).alias("inside"))


def _steps(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(T(spark, d, "steps"), ["run_id", "step_index"], "saved_at", cols)


_S = "s AS (SELECT * FROM steps WHERE run_id IS NOT NULL AND step_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, step_index ORDER BY saved_at DESC NULLS LAST) = 1)"


@query("WITH " + _S + """, x AS (SELECT CASE WHEN coalesce(status IN ('ok', 'failed', 'cached'), false) THEN NULL ELSE 'status' END AS a,
 CASE WHEN coalesce(status <> 'failed' OR length(error) > 0, false) THEN NULL ELSE 'error' END AS b, CASE WHEN coalesce(duration_s >= 0, false) THEN NULL ELSE 'duration' END AS c,
 CASE WHEN coalesce(replay_of IS NULL OR replay_of < step_index, false) THEN NULL ELSE 'replay' END AS e FROM s),
y AS (SELECT unnest([a, b, c, e]) AS problem FROM x) SELECT problem, CAST(count(*) AS BIGINT) AS steps FROM y WHERE problem IS NOT NULL GROUP BY 1""")
def step_problems(spark: SparkSession, d: str) -> DataFrame:
    """How many steps break each rule of a step record."""
    rules = {
        "status": F.col("status").isin("ok", "failed", "cached"),
        "error": (F.col("status") != "failed") | (F.length("error") > 0),
        "duration": F.col("duration_s") >= 0,
        "replay": F.col("replay_of").isNull() | (F.col("replay_of") < F.col("step_index")),
    }
    v = R.validated(_steps(spark, d, "status", "error", "duration_s", "replay_of"), rules)
    return v.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("steps"))


@query("WITH " + _S + """ SELECT run_id, step_index, array_to_string(list_sort(list_filter(map_keys(params), lambda k: lower(k) NOT IN ('seed', 'window'))), ',') AS params,
 array_to_string(list_sort(list_filter(map_keys(metrics), lambda k: lower(k) NOT IN ('seed', 'window'))), ',') AS metrics FROM s""")
def scrubbed_steps(spark: SparkSession, d: str) -> DataFrame:
    """Names that stay in the steps' parameters and metrics when two are withheld."""
    s = R.scrubbed(_steps(spark, d, "params", "metrics"), ["params", "metrics"], ["seed", "window"])
    names = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",").alias(c)
    return s.select("run_id", "step_index", names("params"), names("metrics"))


_LEGS = "l AS (SELECT leg_id, $CAP AS capture, profile.registration AS registration, profile.coverage AS coverage, profile.point_count AS point_count FROM all_legs WHERE leg_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY leg_id ORDER BY recorded_at DESC NULLS LAST) = 1)"


def _legs(spark: SparkSession, d: str) -> DataFrame:
    legs = T(spark, d, "all_legs").select("leg_id", tidy("capture").alias("capture"), "recorded_at", *[F.col(f"profile.{c}").alias(c) for c in ("registration", "coverage", "point_count")])
    return latest(legs, ["leg_id"], "recorded_at", ["capture", "registration", "coverage", "point_count"])


@query("WITH " + _LEGS + """, r AS (SELECT doc_id, $CAP AS capture, unnest(list_filter(regexp_extract_all(text, '[0-9.]+'), lambda x: x[1] <> '.')) AS run FROM documents WHERE capture IS NOT NULL),
n AS (SELECT DISTINCT doc_id, capture, split_part(run, '.', 1) AS form FROM r UNION SELECT doc_id, capture, split_part(run, '.', 1) || '.' || split_part(run, '.', 2) FROM r WHERE split_part(run, '.', 2) <> '')
SELECT DISTINCT doc_id, capture, form FROM n JOIN (SELECT capture, CAST(point_count AS VARCHAR) AS form FROM l) USING (capture, form)""")
def leaked_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the point count of a leg of their capture as a number of its own."""
    docs = T(spark, d, "documents").select("doc_id", "text", tidy("capture").alias("capture"))
    return R.leaks(docs, "doc_id", "text", "capture", _legs(spark, d).select("capture", F.col("point_count").cast("string").alias("form")), "form").distinct()


@query("""WITH a AS (SELECT s_nationkey AS k, round(min(s_acctbal), 2) AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1), b AS (SELECT c_nationkey AS k, round(min(c_acctbal), 2) AS v FROM customer GROUP BY 1)
SELECT n_nationkey, coalesce(a.v, b.v) AS v FROM nation LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey""")
def precedence(spark: SparkSession, d: str) -> DataFrame:
    """A value from suppliers where there is one, else from customers."""
    a = T(spark, d, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.round(F.min("s_acctbal"), 2).alias("v"))
    b = T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.min("c_acctbal"), 2).alias("v"))
    return R.preferred(T(spark, d, "nation").select("n_nationkey"), ["n_nationkey"], [a, b], ["v"])


def _observed(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "observations").select(tidy("capture").alias("scope"), "track_id", "frame_idx", "feature_idx", "visibility", "x", "y")


_O = "o AS (SELECT DISTINCT $CAP AS scope, track_id AS t, frame_idx AS f FROM observations WHERE capture IS NOT NULL AND track_id IS NOT NULL AND frame_idx IS NOT NULL)"


@query("WITH " + _O + " SELECT x.scope AS scope, x.f AS a, y.f AS b, CAST(count(*) AS BIGINT) AS shared FROM o x JOIN o y ON x.scope = y.scope AND x.t = y.t AND x.f < y.f GROUP BY ALL")
def shared_tracks(spark: SparkSession, d: str) -> DataFrame:
    return R.shared_by_pairs(_observed(spark, d), ["scope"], "frame_idx", "track_id")


@query("WITH " + _O + " SELECT x.scope AS scope, x.f AS a, y.f AS b, z.f AS c, CAST(count(*) AS BIGINT) AS shared FROM o x JOIN o y ON x.scope = y.scope AND x.t = y.t AND x.f < y.f JOIN o z ON z.scope = x.scope AND z.t = x.t AND y.f < z.f GROUP BY ALL")
def shared_triples(spark: SparkSession, d: str) -> DataFrame:
    return R.shared_by_triples(_observed(spark, d), ["scope"], "frame_idx", "track_id")


@query("WITH " + _M + """, k AS (SELECT $CAP AS scope, frame_idx AS i, feature_idx AS f, min(track_id) AS t FROM observations WHERE capture IS NOT NULL AND frame_idx IS NOT NULL AND feature_idx IS NOT NULL GROUP BY ALL)
SELECT m.scope AS scope, CAST(count(*) AS BIGINT) AS matches, CAST(count(*) FILTER (NOT coalesce(a.t = b.t AND a.t >= 0, false)) AS BIGINT) AS held_out FROM m
LEFT JOIN k a ON a.scope = m.scope AND a.i = image_i AND a.f = feature_i LEFT JOIN k b ON b.scope = m.scope AND b.i = image_j AND b.f = feature_j WHERE m.scope IS NOT NULL GROUP BY 1""")
def held_out_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches that the built tracks do not already hold, by capture."""
    key = ["scope", "image", "feature"]
    k = _observed(spark, d).select("scope", F.col("frame_idx").alias("image"), F.col("feature_idx").alias("feature"), "track_id").dropna(subset=key).groupBy(*key).agg(F.min("track_id").alias("t"))
    at = lambda s, n: k.select("scope", F.col("image").alias(f"image_{s}"), F.col("feature").alias(f"feature_{s}"), F.col("t").alias(n))
    m = _matches(spark, d).filter("scope IS NOT NULL").select("scope", "image_i", "feature_i", "image_j", "feature_j")
    j = Scratch(spark).write(m.join(at("i", "a"), ["scope", "image_i", "feature_i"], "left").join(at("j", "b"), ["scope", "image_j", "feature_j"], "left").select("scope", "a", "b")).df
    out = R.held_out(j, "a", "b").groupBy("scope").agg(F.count(F.lit(1)).alias("held_out"))
    return j.groupBy("scope").agg(F.count(F.lit(1)).alias("matches")).join(out, "scope", "left").withColumn("held_out", F.coalesce("held_out", F.lit(0)))


def _ends(spark: SparkSession, d: str) -> DataFrame:
    m = _matches(spark, d).filter("scope IS NOT NULL").groupBy("match_idx").agg(F.min(F.struct("scope", "image_i", "image_j", "feature_i", "feature_j", "x1", "y1", "x2", "y2")).alias("v")).select("match_idx", "v.*")
    names = {"match_idx": "seq", "image_i": "i", "image_j": "j", "feature_i": "fi", "feature_j": "fj", "x1": "xi", "y1": "yi", "x2": "xj", "y2": "yj"}
    return m.withColumnsRenamed(names)


_E = "WITH " + _M + """, u AS (SELECT match_idx AS seq, min({'a': scope, 'b': image_i, 'c': image_j, 'd': feature_i, 'e': feature_j, 'f': x1, 'g': y1, 'h': x2, 'i': y2}) AS v FROM m WHERE scope IS NOT NULL GROUP BY 1),
e AS (SELECT v.a AS scope, v.b AS image, v.d AS feature, v.f AS x, v.g AS y, seq, 0 AS side FROM u UNION ALL SELECT v.a, v.c, v.e, v.h, v.i, seq, 1 FROM u)"""


@query(_E + " SELECT scope, image, feature, arg_max(x, (side, seq)) AS x, arg_max(y, (side, seq)) AS y FROM e WHERE feature IS NOT NULL GROUP BY ALL")
def node_positions(spark: SparkSession, d: str) -> DataFrame:
    """Keypoints where they were written last, second ends after first ends."""
    return R.node_table(_ends(spark, d))


@query(_E + " SELECT scope, image, CAST(row_number() OVER (PARTITION BY scope, image ORDER BY seq, side) - 1 AS BIGINT) AS row, seq, side FROM e WHERE image IS NOT NULL")
def endpoint_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.keypoint_rows(_ends(spark, d))


@query("""WITH c AS (SELECT orderkey, cx, cy, min(line) AS o FROM (SELECT l_suppkey AS orderkey, CAST(round_even(l_extendedprice / 5000, 0) AS BIGINT) AS cx, CAST(round_even(l_quantity / 10, 0) AS BIGINT) AS cy, l_orderkey * 8 + l_linenumber AS line FROM lineitem) GROUP BY ALL)
SELECT orderkey AS l_suppkey, cx, cy, CAST(row_number() OVER (PARTITION BY orderkey ORDER BY o, cx, cy) - 1 AS BIGINT) AS cell FROM c""")
def cell_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Lattice cells of each supplier's lines, numbered as they first occur."""
    from skerry.operators.matching import quantize

    l = T(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 5000).alias("x"), (F.col("l_quantity") / 10).alias("y"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))
    return R.first_seen_ids(quantize(l, "x", "y", 1.0), ["l_suppkey"], ["cx", "cy"], "line", "cell")


@query("""WITH RECURSIVE """ + _M + """, d AS (SELECT DISTINCT scope, image_i, feature_i, image_j, feature_j FROM m WHERE scope IS NOT NULL AND feature_i IS NOT NULL AND feature_j IS NOT NULL),
e AS (SELECT scope, image_i AS i, feature_i AS f, image_j AS i2, feature_j AS f2 FROM d UNION SELECT scope, image_j, feature_j, image_i, feature_i FROM d),
r AS (SELECT DISTINCT scope, i, f, i AS gi, f AS gf FROM e UNION SELECT r.scope, e.i2, e.f2, r.gi, r.gf FROM r JOIN e ON e.scope = r.scope AND e.i = r.i AND e.f = r.f WHERE (r.gi, r.gf) < (e.i2, e.f2)),
g AS (SELECT scope, i, f, min((gi, gf)) AS g FROM r GROUP BY ALL), s AS (SELECT scope, g, count(DISTINCT i) >= 3 AS multi FROM g GROUP BY ALL)
SELECT scope, CAST(count(*) AS BIGINT) AS groups, CAST(count(*) FILTER (multi) AS BIGINT) AS multiview, round(avg(CAST(multi AS INT)), 6) AS fraction FROM s GROUP BY 1""")
def multiview(spark: SparkSession, d: str) -> DataFrame:
    m = _matches(spark, d).filter("scope IS NOT NULL").withColumnsRenamed({"image_i": "i", "image_j": "j", "feature_i": "fi", "feature_j": "fj"})
    return R.multiview_fraction(m).withColumn("fraction", F.round("fraction", 6))


@query("""SELECT capture, pair_idx, match_count FROM (SELECT DISTINCT $CAP AS capture, pair_idx, match_count FROM pairs WHERE capture IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY capture ORDER BY match_count DESC NULLS LAST, pair_idx) <= 20""")
def strongest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The 20 pairs of each capture with the most matches."""
    p = T(spark, d, "pairs").select(tidy("capture").alias("capture"), "pair_idx", "match_count").filter("capture IS NOT NULL").distinct()
    return S.top_k(p, ["capture"], [F.desc_nulls_last("match_count"), F.asc("pair_idx")], 20)


@query("WITH " + _S + " SELECT run_id, step_index, saved_at FROM s ORDER BY saved_at DESC, run_id, step_index LIMIT 50")
def recent_steps(spark: SparkSession, d: str) -> DataFrame:
    """The 50 steps saved last (the limit is the feature)."""
    return latest(T(spark, d, "steps").withColumn("at", F.col("saved_at")), ["run_id", "step_index"], "at", ["saved_at"]).orderBy(F.desc("saved_at"), "run_id", "step_index").limit(50)


@query("""SELECT c_nationkey, c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 16) AS BIGINT) AS chunk FROM customer""")
def passes(spark: SparkSession, d: str) -> DataFrame:
    return R.chunked(T(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 16)


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, bool_and(gap > 0) AS rising, median(gap) / 1000000 AS median_gap FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def event_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Whether a user's events rise strictly in time, and the median gap in seconds."""
    from skerry.operators.aggregates import exact_percentiles

    e = T(spark, d, "events").select("user_id", "event_id", "ts", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)").alias("us"))
    g = R.steps_between(e, ["user_id"], ["ts", "event_id"], "us").filter("gap IS NOT NULL")
    return g.groupBy("user_id").agg(F.bool_and(F.col("gap") > 0).alias("rising")).join(exact_percentiles(g, ["user_id"], "gap", {"m": 0.5}), "user_id").select("user_id", "rising", (F.col("m") / 1000000).alias("median_gap"))


@query("""WITH k AS (SELECT DISTINCT $CAP AS key FROM scenes WHERE capture IS NOT NULL), t AS (SELECT DISTINCT split_part(key, '/', 2) AS token FROM k UNION SELECT key FROM k UNION SELECT 'x/none'),
u AS (SELECT split_part(key, '/', 2) AS leaf, min(key) AS only FROM k GROUP BY 1 HAVING count(*) = 1)
SELECT token, CASE WHEN contains(token, '/') THEN k.key ELSE u.only END AS key FROM t LEFT JOIN k ON k.key = t.token LEFT JOIN u ON u.leaf = t.token""")
def canonical_captures(spark: SparkSession, d: str) -> DataFrame:
    """Which capture a bare or full name means."""
    k = T(spark, d, "scenes").select(tidy("capture").alias("key")).dropna().distinct()
    sets = {r[0]: r[0] for r in k.select(F.substring_index("key", "/", 1)).distinct().collect()}  # the few sets of captures
    tokens = k.select(F.substring_index("key", "/", -1).alias("token")).union(k).union(spark.createDataFrame([("x/none",)], "token string")).distinct()
    return R.canonical(tokens, "token", k, "key", families=sets).select("token", "key")


@query("""SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + 3661 AS s FROM orders""")
def exif_times(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").select("o_orderkey", R.exif_seconds(F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" 01:01:01"))).alias("s"))


@query("WITH " + _S + """, c AS (SELECT a.run_id, a.step_index, a.params AS p, b.params AS q FROM s a JOIN s b ON a.run_id = b.run_id AND a.replay_of = b.step_index),
k AS (SELECT run_id, step_index, p, q, unnest(list_distinct(list_concat(coalesce(map_keys(p), []), coalesce(map_keys(q), [])))) AS key FROM c)
SELECT run_id, step_index, key FROM k WHERE map_contains(p, key) IS DISTINCT FROM map_contains(q, key) OR p[key] IS DISTINCT FROM q[key]""")
def replay_changes(spark: SparkSession, d: str) -> DataFrame:
    """Parameters that differ between a step and the one it replays."""
    s = Scratch(spark).write(_steps(spark, d, "params", "replay_of")).df
    j = s.filter("replay_of IS NOT NULL").join(s.select("run_id", F.col("step_index").alias("replay_of"), F.col("params").alias("before")), ["run_id", "replay_of"])
    return j.select("run_id", "step_index", F.explode(R.map_changes(F.col("before"), F.col("params"))).alias("key"))


@query("WITH " + _LEGS + """, c AS (SELECT comparison_id, list(DISTINCT CAST(leg_id AS VARCHAR)) AS o, list(DISTINCT CAST(leg_id AS VARCHAR)) FILTER (registration >= 30 AND NOT isnan(registration)) AS k
FROM (SELECT DISTINCT comparison_id, leg_id FROM comparisons) JOIN l USING (leg_id) GROUP BY 1)
SELECT comparison_id, coalesce(len(k), 0) >= greatest(1, ceil(0.5 * len(o))) AS enough FROM c""")
def supported_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons of whose legs half or more register well."""
    c = T(spark, d, "comparisons").select("comparison_id", "leg_id").dropna().distinct().join(_legs(spark, d), "leg_id")
    good = (F.col("registration") >= 30) & ~F.isnan("registration")
    sets = c.groupBy("comparison_id").agg(F.collect_set(F.col("leg_id").cast("string")).alias("o"), F.collect_set(F.when(good, F.col("leg_id").cast("string"))).alias("k"))
    return sets.select("comparison_id", R.enough(F.col("k"), F.col("o"), 0.5).alias("enough"))


@query("""WITH e AS (SELECT DISTINCT split_part($CAP, '/', 1) AS entry FROM scenes WHERE capture IS NOT NULL), p AS (SELECT DISTINCT '/data/' || $CAP || '/img' AS path FROM scenes WHERE capture IS NOT NULL)
SELECT path, entry FROM p LEFT JOIN e ON contains(path, '/' || entry || '/')""")
def corpus_members(spark: SparkSession, d: str) -> DataFrame:
    """The corpus entry (a leading segment) that each image folder lies under."""
    k = T(spark, d, "scenes").select(tidy("capture").alias("c")).dropna().distinct()
    return R.under_entries(k.select(F.concat(F.lit("/data/"), "c", F.lit("/img")).alias("path")), "path", k.select(F.substring_index("c", "/", 1).alias("entry")), "entry")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = 0 THEN 0.0 ELSE round_even(l_extendedprice * pow(10.0, 3 - floor(log10(abs(l_extendedprice)))), 0) / pow(10.0, 3 - floor(log10(abs(l_extendedprice)))) END AS price FROM lineitem""")
def significant_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices to four significant digits."""
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.significant(F.col("l_extendedprice"), 4).alias("price"))
