"""p4: briefs as flat tables, and step records flattened by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.briefs import brief_facets
from skerry.operators.nested import flatten
from skerry.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brief_facets(table(spark, sf_dir, "briefs"))


def flatten_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list in the step records, as one table: maps as lists of key and value, and a list of lists within."""
    steps = table(spark, sf_dir, "steps")
    entries = lambda c: F.map_entries(c).alias(c)
    files = F.array(*[F.struct(F.lit(c).alias("side"), F.map_entries(c).alias("items")) for c in ("inputs", "outputs")])
    rec = F.struct("diagnostics", entries("metrics"), files.alias("files")).alias("rec")
    t = flatten(steps.select("run_id", "step_index", rec), ["run_id", "step_index"], "rec")
    text = lambda n, at, key, value: t[n].select("run_id", "step_index", F.lit(n).alias("list"), at.alias("place"), key.alias("key"), value.alias("value"))
    one = F.col("at_1").cast("string")
    out = text("diagnostics[]", one, F.lit(None).cast("string"), F.col("v"))
    out = out.unionByName(text("metrics[]", one, F.col("v_key"), F.format_number("v_value", 6)))
    out = out.unionByName(text("files[]", one, F.col("v_side"), F.lit(None).cast("string")))
    return out.unionByName(text("files[].items[]", F.concat_ws("/", "at_1", "at_2"), F.col("v_key"), F.col("v_value")))


QUERIES = {"p4_found": p4_found, "flatten_steps": flatten_steps}
SQL: dict[str, str] = {
    "flatten_steps": """
WITH s AS (SELECT run_id, step_index, diagnostics, map_entries(metrics) AS m, [{'side': 'inputs', 'items': map_entries(inputs)}, {'side': 'outputs', 'items': map_entries(outputs)}] AS files FROM steps),
f AS (SELECT run_id, step_index, unnest(files) AS x, generate_subscripts(files, 1) - 1 AS i FROM s),
e AS (SELECT run_id, step_index, i, unnest(x.items) AS y, generate_subscripts(x.items, 1) - 1 AS j FROM f)
SELECT run_id, step_index, 'diagnostics[]' AS list, CAST(i AS VARCHAR) AS place, NULL AS key, v AS value
  FROM (SELECT run_id, step_index, unnest(diagnostics) AS v, generate_subscripts(diagnostics, 1) - 1 AS i FROM s)
UNION ALL SELECT run_id, step_index, 'metrics[]', CAST(i AS VARCHAR), y.key, format('{:,.6f}', y.value)
  FROM (SELECT run_id, step_index, unnest(m) AS y, generate_subscripts(m, 1) - 1 AS i FROM s)
UNION ALL SELECT run_id, step_index, 'files[]', CAST(i AS VARCHAR), x.side, NULL FROM f
UNION ALL SELECT run_id, step_index, 'files[].items[]', i || '/' || j, y.key, y.value FROM e"""
}
