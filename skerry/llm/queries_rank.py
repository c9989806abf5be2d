"""p1 and p3: the best legs of a capture, and one order of the legs of a comparison."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import tidy
from skerry.llm.rankfuse import Score, fused_scores
from skerry.llm.topn import Order, top_n
from skerry.plans.skew import hot_keys, latest, skew_join
from skerry.runtime import Scratch, table


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = table(spark, sf_dir, "all_legs").select("leg_id", tidy("capture").alias("capture"), "recorded_at", *[F.col(f"profile.{c}").alias(c) for c in ("registration", "point_count", "error", "pose_agreement")])
    return latest(legs, ["leg_id"], "recorded_at", ["capture", "registration", "point_count", "error", "pose_agreement"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(_legs(spark, sf_dir), "capture", [Order("registration", gaps="out"), Order("point_count")], "leg_id", 3)


SCORES = [Score("registration"), Score("error", False), Score("point_count"), Score("pose_agreement", False)]


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    asked = s.write(table(spark, sf_dir, "comparisons").select("comparison_id", "leg_id").dropna().distinct())
    rows = skew_join(asked.df, _legs(spark, sf_dir), ["leg_id"], "inner", hot_keys(asked.df, ["leg_id"], asked.rows))
    return fused_scores(rows, ["comparison_id"], "leg_id", SCORES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by("leg_id", F.struct("fused", -F.col("leg_id")))
    return _fused(spark, sf_dir).groupBy("comparison_id").agg(best.alias("leg_id"))


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking: every leg of every comparison with its fused score."""
    return _fused(spark, sf_dir).withColumn("fused", F.round("fused", 5) + F.lit(0.0))


_LEGS = """WITH l AS (
  SELECT leg_id, lower(trim(capture, E' \\t\\r\\n')) AS capture, profile.registration AS registration, profile.point_count AS point_count,
    profile.error AS error, profile.pose_agreement AS pose_agreement FROM all_legs WHERE leg_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY leg_id ORDER BY recorded_at DESC NULLS LAST) = 1)"""

#: Normal quantiles of k / 2n for groups of up to 24 items, as rows of SQL.
_QUANTILES = ", ".join(f"({n}, {k}, {NormalDist().inv_cdf(k / (2 * n))!r})" for n in range(1, 25) for k in range(1, 2 * n))
_FUSED = (
    _LEGS
    + f""", c AS (SELECT DISTINCT comparison_id, leg_id FROM comparisons WHERE comparison_id IS NOT NULL AND leg_id IS NOT NULL),
x AS (SELECT comparison_id, leg_id, [registration, -error, CAST(point_count AS DOUBLE), -pose_agreement] AS vs FROM c JOIN l USING (leg_id)),
y AS (SELECT comparison_id, leg_id, unnest([0, 1, 2, 3]) AS w, unnest(list_transform(vs, lambda v: CASE WHEN v IS NULL OR isnan(v) THEN CAST('-Infinity' AS DOUBLE) ELSE v END)) AS v FROM x),
r AS (SELECT comparison_id, leg_id, 2 * (rank() OVER (PARTITION BY comparison_id, w ORDER BY v) - 1) + count(*) OVER (PARTITION BY comparison_id, w, v) AS k, count(*) OVER (PARTITION BY comparison_id, w) AS n FROM y),
z(n, k, z) AS (VALUES {_QUANTILES}), f AS (SELECT comparison_id, leg_id, round(sum(z) / 4, 9) AS fused FROM r JOIN z USING (n, k) GROUP BY ALL)"""
)

SQL = {
    "p3_found": _FUSED + " SELECT comparison_id, arg_max(leg_id, (fused, -leg_id)) AS leg_id FROM f GROUP BY 1",
    "p3_scores": _FUSED + " SELECT comparison_id, leg_id, round(fused, 5) + 0.0 AS fused FROM f",
    "p1_found": _LEGS
    + """ SELECT capture, CAST(row_number() OVER (PARTITION BY capture ORDER BY registration DESC, point_count DESC NULLS LAST, leg_id) AS INT) AS place, leg_id
FROM l WHERE capture IS NOT NULL AND registration IS NOT NULL AND NOT isnan(registration) QUALIFY place <= 3""",
}
QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_scores": p3_scores}
