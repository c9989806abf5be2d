"""Statistics and selections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import aggregates as A
from skerry.operators import constraints as K
from skerry.operators import selection as S
from skerry.plans.skew import latest
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


def _r(df: DataFrame, **places: int) -> DataFrame:
    """Rounds as SQL's CAST(x * 10^p + ... ) would: both sides of a comparison use the same expression."""
    return df.withColumns({c: F.round(F.col(c), p) for c, p in places.items()})


@query("""SELECT c_custkey, p.o_orderpriority AS o_orderpriority, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer
CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN orders o ON o.o_custkey = c_custkey AND o.o_orderpriority = p.o_orderpriority GROUP BY ALL""")
def zero_fill_counts(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    domain = T(spark, d, "customer").select("c_custkey").join(F.broadcast(o.select("o_orderpriority").distinct()))  # five priorities
    return A.zero_filled_counts(o, domain, ["c_custkey", "o_orderpriority"])


@query("""WITH m AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS month FROM lineitem), b AS (SELECT l_suppkey FROM m GROUP BY 1 HAVING count(*) >= 3)
SELECT strftime(month, '%Y-%m') AS month, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n FROM m WHERE l_suppkey IN (SELECT l_suppkey FROM b) GROUP BY 1""")
def long_tracks_per_frame(spark: SparkSession, d: str) -> DataFrame:
    l = T(spark, d, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return A.conditional_counts(l, "l_suppkey", "month", 3, l)


@query("""WITH s AS (SELECT l_orderkey, count(*) AS len FROM lineitem GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS groups, round(avg(len), 6) AS mean_len, CAST(max(len) AS BIGINT) AS max_len, round(avg(CAST(len >= 3 AS INT)), 6) AS share_3,
 round(avg(CAST(len >= 5 AS INT)), 6) AS share_5, CAST(median(len) AS DOUBLE) AS median_len FROM s""")
def survival_fractions(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.survival(T(spark, d, "lineitem"), ["l_orderkey"]), mean_len=6, share_3=6, share_5=6)


@query("""WITH e AS (SELECT max(l_extendedprice) AS w, max(l_quantity) AS h FROM lineitem)
SELECT l_returnflag, count(DISTINCT least(floor(l_quantity / h * 8), 7) * 8 + least(floor(l_extendedprice / w * 8), 7)) / 64 AS coverage FROM lineitem, e GROUP BY 1""")
def coverage_cells(spark: SparkSession, d: str) -> DataFrame:
    l = T(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    e = l.agg(F.max("l_extendedprice").alias("w"), F.max("l_quantity").alias("h"))
    return A.coverage(l.join(F.broadcast(e)), ["l_returnflag"], F.col("l_extendedprice"), F.col("l_quantity"), F.col("w"), F.col("h"), l)  # one row


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.02), 4) AS p2, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
 round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    want = {"p2": 0.02, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    return _r(A.exact_percentiles(T(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", want), **dict.fromkeys(want, 4))


@query("""WITH w AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(q) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum, sum(q) OVER (PARTITION BY l_returnflag) AS total FROM w)
SELECT l_returnflag, min(v) AS weighted_median FROM c WHERE cum >= 0.5 * total GROUP BY 1""")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return A.weighted_median(T(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


@query("""WITH m AS (SELECT l_linestatus, median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem GROUP BY 1),
a AS (SELECT l_linestatus, median(abs(l_extendedprice - m)) AS mad FROM lineitem JOIN m USING (l_linestatus) GROUP BY 1)
SELECT l_linestatus, round(m, 4) AS median, round(mad, 4) AS mad, round(1.4826 * mad / abs(m), 6) AS robust_cv, round(iqr, 4) AS iqr FROM m JOIN a USING (l_linestatus)""")
def mad_cv(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.spread_measures(T(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice"), median=4, mad=4, robust_cv=6, iqr=4)


@query("""WITH o AS (SELECT l_orderkey, count(*) AS n, round(avg(l_discount), 8) AS v FROM lineitem GROUP BY 1)
SELECT CAST(b AS INT) AS bucket, CAST(count(n) AS BIGINT) AS points, round(median(v), 6) AS median FROM range(2, 6) t(b) LEFT JOIN o ON least(n, 5) = b GROUP BY 1""")
def support_buckets(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 8).alias("v"))
    return _r(A.by_support(o, "n", "v"), median=6)


@query("""WITH e AS (SELECT l_partkey AS member, l_extendedprice AS v FROM lineitem UNION ALL SELECT l_suppkey, l_extendedprice FROM lineitem)
SELECT member, CAST(count(*) AS BIGINT) AS pairs, max(v) AS worst, round(median(v), 4) AS median FROM e GROUP BY 1""")
def both_ends_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.both_ends_rollup(T(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice"), median=4)


@query("""SELECT c_mktsegment, c_custkey, c_acctbal, round(100 * (rank() OVER w - 1 + 0.5 * count(*) OVER (PARTITION BY c_mktsegment, c_acctbal)) / count(*) OVER (PARTITION BY c_mktsegment), 6) AS pct
FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal)""")
def mid_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.mid_rank_percentile(T(spark, d, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal"), pct=6)


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.spearman(T(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), rho=6)


_LATEST = """l AS (SELECT leg_id, lower(trim(capture, E' \\t\\r\\n')) AS capture, profile.* FROM all_legs QUALIFY row_number() OVER (PARTITION BY leg_id ORDER BY recorded_at DESC NULLS LAST) = 1)"""


def _legs(spark: SparkSession, d: str) -> DataFrame:
    from skerry.functions.text import tidy

    legs = T(spark, d, "all_legs").select("leg_id", tidy("capture").alias("capture"), "recorded_at", "profile.*", "gt_rot")
    return latest(legs, ["leg_id"], "recorded_at", [c for c in legs.columns if c not in ("leg_id", "recorded_at")])


@query("WITH " + _LATEST + """, r AS (UNPIVOT (SELECT leg_id, registration, conditioning, composition, coverage FROM l) ON registration, conditioning, composition, coverage INTO NAME reading VALUE v)
SELECT reading, CAST(count(*) AS BIGINT) AS n, round(min(v), 6) AS least, round(max(v), 6) AS greatest, round(median(v), 6) AS median FROM r WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1""")
def reference_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.distribution_table(_legs(spark, d), ["registration", "conditioning", "composition", "coverage"]), least=6, greatest=6, median=6)


@query("""WITH c AS (SELECT DISTINCT comparison_id, leg_id FROM comparisons), l AS (SELECT leg_id, gt_rot AS t, profile.registration AS a, profile.coverage AS b FROM all_legs QUALIFY row_number() OVER (PARTITION BY leg_id ORDER BY recorded_at DESC NULLS LAST) = 1),
x AS (SELECT comparison_id, leg_id, CASE WHEN isnan(t) THEN NULL ELSE t END AS t, CASE WHEN isnan(a) THEN NULL ELSE a END AS a, CASE WHEN isnan(b) THEN NULL ELSE b END AS b FROM c JOIN l USING (leg_id)),
p AS (SELECT (x.a - y.a) * (y.t - x.t) AS da, (x.b - y.b) * (y.t - x.t) AS db FROM x JOIN x y ON x.comparison_id = y.comparison_id AND x.leg_id < y.leg_id WHERE x.t <> y.t)
SELECT 'registration' AS reading, CAST(count(*) FILTER (da > 0) AS BIGINT) AS "right", CAST(count(*) FILTER (da < 0) AS BIGINT) AS wrong, CAST(count(*) FILTER (da IS NULL OR da = 0) AS BIGINT) AS unevaluable FROM p
UNION ALL SELECT 'coverage', count(*) FILTER (db > 0), count(*) FILTER (db < 0), count(*) FILTER (db IS NULL OR db = 0) FROM p""")
def ranking_tally(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "comparisons").select("comparison_id", "leg_id").distinct().join(_legs(spark, d), "leg_id")
    gap = lambda x: F.nanvl(F.col(x), F.lit(None).cast("double")).alias(x)
    return A.ranking_tally(c.select("comparison_id", "leg_id", gap("gt_rot"), gap("registration"), gap("coverage")), "comparison_id", "leg_id", "gt_rot", ["registration", "coverage"])


@query("""WITH p AS (SELECT c_custkey, 100 * (rank() OVER (ORDER BY c_acctbal) - 1 + 0.5 * count(*) OVER (PARTITION BY c_acctbal)) / count(*) OVER () AS balance,
 100 * (rank() OVER (ORDER BY c_nationkey) - 1 + 0.5 * count(*) OVER (PARTITION BY c_nationkey)) / count(*) OVER () AS nation FROM customer)
SELECT c_custkey, CASE WHEN balance <= nation THEN 'balance' ELSE 'nation' END AS weakest, round(least(balance, nation), 6) AS pct FROM p""")
def weakest_rung(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "customer").withColumn("one", F.lit(1))
    a = A.mid_rank_percentile(c, ["one"], "c_custkey", "c_acctbal", out="balance").select("c_custkey", "balance")
    b = A.mid_rank_percentile(c, ["one"], "c_custkey", "c_nationkey", out="nation").select("c_custkey", "nation")
    return _r(A.weakest_rung(a.join(b, "c_custkey"), "c_custkey", ["balance", "nation"]), pct=6)


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
f AS (SELECT user_id, i, value AS est FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, f.est + CASE WHEN e.value > f.est THEN 0.6 ELSE 0.2 END * (e.value - f.est) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, round(arg_max(est, i), 4) AS estimate, CAST(max(i) AS BIGINT) AS n FROM f GROUP BY 1""")
def ewma_fold(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.asymmetric_ewma(T(spark, d, "events"), "user_id", ["ts", "event_id"], "value"), estimate=4)


@query("""WITH c AS (SELECT event_type, CAST(greatest(0, least(15, floor(value / 6.25))) AS INT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT event_type, bin, round(n / sum(n) OVER (PARTITION BY event_type), 8) AS share FROM c""")
def histograms(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.histogram(T(spark, d, "events"), ["event_type"], "value", 0.0, 100.0, 16), share=8)


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS place FROM events QUALIFY place <= 5""")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events").select("user_id", "event_id", "value")
    return S.top_k(e, ["user_id"], [F.desc_nulls_last("value"), F.asc("event_id")], 5, rank="place").drop("value")


@query("""SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1""")
def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    return S.best_per_group(T(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")])


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT DISTINCT user_id, CASE WHEN n <= 10 THEN i ELSE CAST(floor(i * ((n - 1) / 9)) AS BIGINT) END AS pos FROM (SELECT DISTINCT user_id, n FROM e), range(0, 10) t(i) WHERE n > 10 OR i < n)
SELECT user_id, event_id FROM e JOIN k USING (user_id, pos)""")
def linspace_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.even_sample(T(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 10).select("user_id", "event_id")


@query("""SELECT o_custkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS dense, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def dense_renumber(spark: SparkSession, d: str) -> DataFrame:
    return S.renumber(T(spark, d, "orders").select("o_custkey"), "o_custkey", "dense").groupBy("o_custkey", "dense").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, CAST(count(*) FILTER (rn > 1) AS BIGINT) AS repeated FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) AS rn FROM events) GROUP BY 1""")
def repeated_in_frame(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events").select("user_id", "event_id", F.concat_ws("/", "event_type", F.to_date("ts").cast("string")).alias("frame"))
    return S.repeated_in_group(e, ["user_id"], "frame", "event_id").groupBy("user_id").agg(F.count_if("repeated").alias("repeated"))


@query("""SELECT c_nationkey, count(DISTINCT n) = count(*) AS ordered, round(count(DISTINCT n) / (max(n) - min(n) + 1), 8) AS density
FROM (SELECT c_nationkey, CAST(regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS n FROM customer) GROUP BY 1""")
def filename_order(spark: SparkSession, d: str) -> DataFrame:
    return _r(S.sequence_check(T(spark, d, "customer"), "c_name", ["c_nationkey"]), density=8)


@query("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (isnan(l_discount)) AS BIGINT) AS l_discount_nan, CAST(count(*) FILTER (isnan(l_tax) OR isinf(l_tax)) AS BIGINT) AS l_tax_nonfinite,
 CAST(count(*) FILTER (l_quantity < 1 OR l_quantity > 40) AS BIGINT) AS l_quantity_outside, max(l_orderkey) + 1 = (SELECT count(*) FROM orders) AS l_orderkey_dense, count(*) > 0 AS nonempty FROM lineitem""")
def invariants_report(spark: SparkSession, d: str) -> DataFrame:
    l, n = T(spark, d, "lineitem"), T(spark, d, "orders").count()
    return K.report(l, [K.NoNaN("l_discount"), K.Finite("l_tax"), K.Within("l_quantity", 1, 40), K.MaxPlusOne("l_orderkey", n), K.NonEmpty()])
