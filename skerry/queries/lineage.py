"""Step logs: dependence, order, attempts, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import tidy
from skerry.operators import graph as G
from skerry.operators import lineage as L
from skerry.plans.skew import latest
from skerry.runtime import Scratch
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


_COLS = ["status", "module", "module_version", "params", "inputs", "outputs", "metrics", "duration_s", "replay_of", "capture", "started_at"]


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Steps as saved last, with tidy artifact names."""
    s = latest(T(spark, d, "steps"), ["run_id", "step_index"], "saved_at", _COLS)
    return Scratch(spark).write(s.withColumns({c: F.transform_values(c, lambda k, v: tidy(v)) for c in ("inputs", "outputs")})).df


_S = """s AS (SELECT * EXCLUDE (inputs, outputs), list_transform(coalesce(map_values(inputs), []), lambda x: lower(trim(x, E' \\t\\r\\n'))) AS ins, list_transform(coalesce(map_values(outputs), []), lambda x: lower(trim(x, E' \\t\\r\\n'))) AS outs
FROM steps WHERE run_id IS NOT NULL AND step_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, step_index ORDER BY saved_at DESC NULLS LAST) = 1),
i AS (SELECT DISTINCT run_id, step_index, unnest(ins) AS source FROM s), o AS (SELECT DISTINCT run_id, step_index, status, unnest(outs) AS target FROM s),
e AS (SELECT DISTINCT source, target FROM i JOIN o USING (run_id, step_index) WHERE status IS DISTINCT FROM 'failed' AND source IS NOT NULL AND target IS NOT NULL)"""


def _failed():
    return F.coalesce(F.col("status") == "failed", F.lit(False))


@query("WITH RECURSIVE " + _S + """, b AS (SELECT DISTINCT target AS start FROM o WHERE step_index = 0 AND target IS NOT NULL), r AS (SELECT start, start AS a FROM b UNION SELECT r.start, e.target FROM r JOIN e ON e.source = r.a),
t AS (SELECT DISTINCT r.start, i.run_id, i.step_index FROM r JOIN i ON i.source = r.a JOIN s USING (run_id, step_index) WHERE s.status IS DISTINCT FROM 'failed')
SELECT start, CAST(count(*) AS BIGINT) AS steps FROM t GROUP BY 1""")
def tainted_steps(spark: SparkSession, d: str) -> DataFrame:
    """How many steps depend on what the first step of a run made."""
    s = _log(spark, d)
    starts = L.produced(s.filter("step_index = 0"), ["run_id"]).select("artifact").distinct()
    return L.downstream(s, ["run_id", "step_index"], starts, "artifact", _failed()).groupBy("start").agg(F.count(F.lit(1)).alias("steps"))


def _made(s: DataFrame) -> DataFrame:
    return s.select("run_id", "step_index", "module", "started_at", F.explode(F.map_values("outputs")).alias("artifact")).dropna(subset=["artifact"])


@query("WITH RECURSIVE " + _S + """, k AS (SELECT DISTINCT target AS node FROM o JOIN s USING (run_id, step_index) WHERE s.module = 'TrackMerge'), r AS (SELECT DISTINCT target AS start, target AS a, 0 AS depth FROM o WHERE target IS NOT NULL
 UNION SELECT r.start, e.source, r.depth + 1 FROM r JOIN e ON e.target = r.a WHERE r.depth < 8)
SELECT start, arg_min(a, (depth, a)) AS nearest, CAST(min(depth) AS INT) AS depth FROM r JOIN k ON k.node = r.a WHERE depth > 0 GROUP BY 1""")
def nearest_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The nearest track artifact upstream of every artifact, at most eight steps."""
    s = _log(spark, d)
    made = _made(s)
    kinds = made.select(F.col("artifact").alias("node"), F.col("module").alias("kind"))
    e = L.edges(s, ["run_id"], _failed())
    return L.nearest_of_type(e, "target", "source", kinds, "TrackMerge", made.select("artifact").distinct(), "artifact")


@query("WITH RECURSIVE " + _S + """, m AS (SELECT DISTINCT target AS node FROM o JOIN s USING (run_id, step_index) WHERE s.cached), r AS (SELECT DISTINCT target AS start, target AS a FROM o WHERE target IS NOT NULL UNION SELECT r.start, e.source FROM r JOIN e ON e.target = r.a)
SELECT start, coalesce(bool_or(m.node IS NOT NULL), false) AS any FROM r LEFT JOIN m ON m.node = r.a GROUP BY 1""")
def built_on_cached(spark: SparkSession, d: str) -> DataFrame:
    """Whether an artifact, or anything it derives from, came out of a cached step."""
    s = Scratch(spark).write(latest(T(spark, d, "steps"), ["run_id", "step_index"], "saved_at", [*_COLS, "cached"]).withColumns({c: F.transform_values(c, lambda k, v: tidy(v)) for c in ("inputs", "outputs")})).df
    made = _made(s).select("artifact").distinct()
    marked = _made(s.filter("cached"))
    return L.any_above(L.edges(s, ["run_id"], _failed()), "target", "source", marked, "artifact", made, "artifact")


@query("WITH " + _S + " SELECT target AS artifact, arg_max(run_id || ':' || step_index, (step_index, run_id)) AS step FROM o WHERE target IS NOT NULL GROUP BY 1")
def producers(spark: SparkSession, d: str) -> DataFrame:
    """The step that made an artifact last."""
    made = _made(_log(spark, d)).select("artifact", F.struct("step_index", "run_id").alias("at"), F.concat_ws(":", "run_id", "step_index").alias("step"))
    return G.latest_producer(made, "artifact", "at", "step")


@query()
def execution_order(spark: SparkSession, d: str) -> DataFrame:
    """The lineage of every verification in order of execution."""
    s = _log(spark, d)
    starts = _made(s.filter("module = 'VerifySparse'")).select("artifact").distinct()
    every = G.closure(L.edges(s, ["run_id"], _failed()), "target", "source")
    up = every.join(starts.select(F.col("artifact").alias("child")), "child", "left_semi").withColumnRenamed("child", "start")
    when = _made(s).groupBy(F.col("artifact").alias("ancestor")).agg(F.min("started_at").alias("started"))
    return L.in_order(up.join(when, "ancestor", "left"), "depth", "started", "ancestor").select("start", "ancestor", "depth", "place")


@query("WITH " + _S + """, a AS (SELECT run_id, step_index, module, replay_of FROM s WHERE status = 'ok'), b AS (SELECT run_id, step_index - step_index % 2 AS step_index, max(module) AS module, max(replay_of) AS replay_of FROM s WHERE status <> 'ok' GROUP BY ALL),
t AS (SELECT run_id, max(step_index) AS top FROM (SELECT run_id, step_index FROM a UNION ALL SELECT run_id, step_index FROM b) GROUP BY 1),
n AS (SELECT b.*, CASE WHEN a.run_id IS NOT NULL THEN top + sum(CASE WHEN a.run_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY b.run_id ORDER BY b.step_index) ELSE b.step_index END AS new FROM b LEFT JOIN a USING (run_id, step_index) JOIN t USING (run_id))
SELECT run_id, step_index, module, replay_of FROM a UNION ALL SELECT n.run_id, CAST(n.new AS INT), n.module, CAST(coalesce(m.new, n.replay_of) AS INT) FROM n LEFT JOIN n m ON m.run_id = n.run_id AND m.step_index = n.replay_of""")
def merged_logs(spark: SparkSession, d: str) -> DataFrame:
    """One writer's steps (ok) and another's (the rest, at even indices, so that many collide) as one log."""
    s = _log(spark, d).select("run_id", "step_index", "module", "replay_of", "status")
    ours = s.filter("status <> 'ok'").groupBy("run_id", (F.col("step_index") - F.col("step_index") % 2).alias("step_index")).agg(F.max("module").alias("module"), F.max("replay_of").alias("replay_of"))
    return L.merge_logs(s.filter("status = 'ok'").drop("status"), ours, "run_id", "step_index", "replay_of")


@query("WITH " + _S + """, f AS (SELECT DISTINCT target AS leaf FROM o ANTI JOIN (SELECT source AS target FROM i WHERE source IS NOT NULL) USING (target) WHERE target IS NOT NULL), c AS (SELECT DISTINCT target AS leaf FROM o JOIN s USING (run_id, step_index) WHERE s.module = 'TriangulateRays' AND target IS NOT NULL),
v AS (SELECT i.source AS leaf, arg_max(s.status, (s.started_at, s.run_id, s.step_index)) AS status FROM i JOIN s USING (run_id, step_index) WHERE s.module = 'VerifySparse' AND i.source IS NOT NULL AND s.status IS NOT NULL GROUP BY 1)
SELECT leaf, coalesce(v.status, 'unverified') AS status FROM (SELECT leaf FROM f UNION SELECT leaf FROM c) LEFT JOIN v USING (leaf)""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The last verdict on every leaf and every triangulation."""
    s = _log(spark, d)
    used = s.select(F.explode(F.map_values("inputs")).alias("artifact"))
    leaves = G.leaves(_made(s).select("artifact"), used, "artifact").unionByName(_made(s.filter("module = 'TriangulateRays'")).select("artifact")).withColumnRenamed("artifact", "leaf")
    checks = s.filter("module = 'VerifySparse' AND status IS NOT NULL").select(F.explode(F.map_values("inputs")).alias("read"), "started_at", "run_id", "step_index", "status")
    return L.latest_verdicts(leaves, "leaf", checks, "read", ["started_at", "run_id", "step_index"], "status")


@query("WITH " + _S + """, a AS (SELECT DISTINCT module, unnest(map_keys(metrics)) AS metric FROM s WHERE status = 'ok'), b AS (SELECT DISTINCT module, unnest(map_keys(params)) AS metric FROM s)
SELECT coalesce(a.module, b.module) AS module, coalesce(a.metric, b.metric) AS metric, CASE WHEN b.metric IS NULL THEN 'missing' ELSE 'undeclared' END AS problem
FROM (SELECT * FROM a WHERE module IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE module IS NOT NULL) b ON a.module = b.module AND a.metric = b.metric WHERE a.metric IS NULL OR b.metric IS NULL""")
def contract_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Names among a module's metrics that are no parameters, and the other way round."""
    s = _log(spark, d)
    names = lambda c, x: x.select("module", F.explode(F.map_keys(c)).alias("metric"))
    return L.contract(names("metrics", s.filter("status = 'ok'")), names("params", s), ["module", "metric"])


@query("WITH " + _S + """, x AS (SELECT lower(trim(capture, E' \\t\\r\\n')) AS capture, module, array_to_string(list_sort(list_transform(map_entries(coalesce(params, MAP {})), lambda p: p.key || '=' || coalesce(p.value, '-'))), ',') AS given, status FROM s WHERE capture IS NOT NULL)
SELECT capture, module, CAST(count(DISTINCT given) AS BIGINT) AS variants, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (status = 'cached') AS BIGINT) AS cached, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed FROM x GROUP BY ALL""")
def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Of each capture and module: variants of parameters tried, runs, cached and failed ones."""
    s = _log(spark, d).withColumn("capture", tidy("capture")).filter("capture IS NOT NULL")
    a = L.attempts(s, ["capture"], "module", "params", "started_at", F.col("status") == "ok")
    return a.groupBy("capture", "module").agg(F.count_distinct("given").alias("variants"), *[F.sum(c).alias(c) for c in ("runs", "cached", "failed")])


@query("WITH " + _S + """, p AS (SELECT lower(trim(capture, E' \\t\\r\\n')) AS capture, module, unnest(map_entries(params)) AS e FROM s WHERE capture IS NOT NULL)
SELECT capture, module, e.key AS param, CAST(count(DISTINCT e.value) AS BIGINT) AS values FROM p GROUP BY ALL HAVING count(DISTINCT e.value) > 1""")
def varied_params(spark: SparkSession, d: str) -> DataFrame:
    s = _log(spark, d).withColumn("capture", tidy("capture")).filter("capture IS NOT NULL")
    return L.varying_params(s, ["capture"], "module", "params")


@query("WITH " + _S + """ SELECT capture, module, arg_min(module_version, (started_at, run_id, step_index)) AS module_version FROM s WHERE capture IS NOT NULL AND module IS NOT NULL AND module_version IS NOT NULL AND started_at IS NOT NULL GROUP BY ALL""")
def first_digests(spark: SparkSession, d: str) -> DataFrame:
    s = _log(spark, d).filter("module_version IS NOT NULL AND started_at IS NOT NULL")
    return L.first_rows(s, ["capture", "module"], ["started_at", "run_id", "step_index"], ["module_version"])


@query("""WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(CASE WHEN doc_id % 5 = 0 THEN upper(lang) ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'right' WHEN b.h IS NULL THEN 'left' ELSE 'changed' END AS "where" FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def drifted_files(spark: SparkSession, d: str) -> DataFrame:
    """Two trees of files made from the documents (some only in one, some changed) and where they differ."""
    t = T(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text", "lang")
    right = t.filter("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("lang")).otherwise(F.col("text")))
    return L.drifted(t.filter("doc_id % 3 <> 0"), right, "path", "text")
