"""Questions to a step log and an artifact catalog: what depends on what, who made it last, what was tried, what was declared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.graph import ancestry, closure
from skerry.runtime import Scratch


def produced(steps: DataFrame, key: Sequence[str], outputs: str = "outputs") -> DataFrame:
    """``key, artifact``: what each step made."""
    return steps.select(*key, F.explode(F.map_values(outputs)).alias("artifact")).dropna(subset=["artifact"]).distinct()


def edges(steps: DataFrame, key: Sequence[str], failed: Column | None = None) -> DataFrame:
    """``key, source, target``: an artifact that a step took and one that it made. Failed steps make none."""
    ok = steps.filter(~failed) if failed is not None else steps
    return ok.select(*key, F.explode(F.map_values("inputs")).alias("source"), "outputs").select(*key, "source", F.explode(F.map_values("outputs")).alias("target")).dropna(subset=["source", "target"]).distinct()


def _above(links: DataFrame, child: str, parent: str, starts: DataFrame, start: str) -> DataFrame:
    """``start, ancestor, depth`` out of the closure: for logs, whose chains are long and whose runs are small."""
    return closure(links, child, parent).join(starts.select(F.col(start).alias("child")).dropna().distinct(), "child", "left_semi").withColumnRenamed("child", "start")


def downstream(steps: DataFrame, key: Sequence[str], starts: DataFrame, start: str, failed: Column | None = None) -> DataFrame:
    """``start, key``: the steps that took an artifact or anything derived from it; failed steps are skipped."""
    s = Scratch(steps.sparkSession)
    derived = s.write(_above(edges(steps, key, failed), "source", "target", starts, start).select("start", F.col("ancestor").alias("artifact")).unionByName(starts.select(F.col(start).alias("start"), F.col(start).alias("artifact")).dropna()).distinct()).df
    live = steps.filter(~failed) if failed is not None else steps
    takes = live.select(*key, F.explode(F.map_values("inputs")).alias("artifact")).dropna().distinct()
    return derived.join(takes, "artifact").select("start", *key).distinct()


def nearest_of_type(links: DataFrame, child: str, parent: str, kinds: DataFrame, wanted: str, starts: DataFrame, start: str, depth: int = 8) -> DataFrame:
    """``start, nearest, depth``: the nearest ancestor of a kind, at most ``depth`` steps up (the smallest of equally near).

    ``kinds(node, kind)``. Starts without such an ancestor have no row.
    """
    up = ancestry(links, child, parent, starts, start, most=depth)
    hit = up.join(kinds.filter(F.col("kind") == wanted).select(F.col("node").alias("ancestor")).distinct(), "ancestor")
    return hit.groupBy("start").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("nearest"), F.min("depth").alias("depth"))


def any_above(links: DataFrame, child: str, parent: str, marked: DataFrame, node: str, starts: DataFrame, start: str) -> DataFrame:
    """``start, any``: whether a start or anything it derives from is marked."""
    up = _above(links, child, parent, starts, start).select("start", "ancestor").unionByName(starts.select(F.col(start).alias("start"), F.col(start).alias("ancestor")).dropna().distinct())
    m = marked.select(F.col(node).alias("ancestor")).dropna().distinct().withColumn("_m", F.lit(True))
    return up.join(m, "ancestor", "left").groupBy("start").agg(F.coalesce(F.bool_or("_m"), F.lit(False)).alias("any"))


def in_order(lineage: DataFrame, depth: str, started: str, item: str) -> DataFrame:
    """An ancestry in order of execution: the deepest first, equals by start and item; adds ``place`` within each ``start``."""
    return lineage.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy(F.desc(depth), F.asc_nulls_first(started), item)) - 1)


def merge_logs(theirs: DataFrame, ours: DataFrame, run: str, index: str, replay_of: str) -> DataFrame:
    """Two writers' steps of the same runs as one log. A step of ours whose index is taken moves to the next free index after
    all of the run; ``replay_of`` of our steps follows ours that moved. Both are unique by (run, index) themselves."""
    taken = theirs.select(run, index, F.lit(True).alias("_taken"))
    top = theirs.select(run, index).unionByName(ours.select(run, index)).groupBy(run).agg(F.max(index).alias("_top"))
    o = ours.join(taken, [run, index], "left").join(top, run, "left")
    moved = F.col("_taken").isNotNull()
    rank = F.sum(moved.cast("int")).over(Window.partitionBy(run).orderBy(index).rowsBetween(Window.unboundedPreceding, 0))  # steps of one run
    o = o.withColumn("_new", F.when(moved, F.col("_top") + rank).otherwise(F.col(index)).cast(ours.schema[index].dataType))
    back = o.select(run, F.col(index).alias(replay_of), F.col("_new").alias("_to"))
    o = o.join(back, [run, replay_of], "left").withColumn(replay_of, F.coalesce("_to", replay_of)).withColumn(index, F.col("_new"))
    return theirs.unionByName(o.select(*theirs.columns))


def latest_verdicts(leaves: DataFrame, leaf: str, verifications: DataFrame, read: str, order: Sequence[str], verdict: str) -> DataFrame:
    """``leaf, verdict``: of each leaf the verdict of the verification that read it last, or ``unverified``."""
    last = verifications.filter(F.col(read).isNotNull()).groupBy(F.col(read).alias(leaf)).agg(F.max_by(verdict, F.struct(*order)).alias(verdict))
    return leaves.select(leaf).dropna().distinct().join(last, leaf, "left").withColumn(verdict, F.coalesce(verdict, F.lit("unverified")))


def contract(declared: DataFrame, emitted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Names that are ``missing`` (declared, never emitted) or ``undeclared`` (emitted, never declared)."""
    key = list(key)
    d, e = declared.select(*key).dropna().distinct().withColumn("_d", F.lit(True)), emitted.select(*key).dropna().distinct().withColumn("_e", F.lit(True))
    j = d.join(e, key, "full")
    return j.filter("_d IS NULL OR _e IS NULL").select(*key, F.when(F.col("_e").isNull(), "missing").otherwise("undeclared").alias("problem"))


def canonical_params(c: Column) -> Column:
    """Parameters as one text, in order of their names; equal for equal maps."""
    return F.to_json(F.array_sort(F.map_entries(c)))


def attempts(steps: DataFrame, scope: Sequence[str], module: str, params: str, order: str, used: Column) -> DataFrame:
    """What was tried in each scope: one row per module and parameters with runs, cached and failed ones, the seconds of the last
    run and whether any was used."""
    scope = list(scope)
    t = steps.withColumn("_p", canonical_params(F.coalesce(params, F.create_map().cast("map<string,string>")))).withColumn("_u", used)
    return t.groupBy(*scope, module, F.col("_p").alias("given")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "cached").alias("cached"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.max_by("duration_s", order).alias("seconds"), F.coalesce(F.bool_or("_u"), F.lit(False)).alias("used"))


def varying_params(steps: DataFrame, scope: Sequence[str], module: str, params: str) -> DataFrame:
    """Parameters that a module was tried with more than one value of in a scope."""
    p = steps.select(*scope, module, F.explode(params).alias("param", "_v"))
    return p.groupBy(*scope, module, "param").agg(F.count_distinct("_v").alias("values")).filter("values > 1")


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each key the first row in order."""
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in columns])


def drifted(left: DataFrame, right: DataFrame, path: str, content: str) -> DataFrame:
    """Paths whose contents differ between two trees: ``changed``, or only in ``left`` or ``right``."""
    a, b = left.select(path, F.md5(content).alias("_a")), right.select(path, F.md5(content).alias("_b"))
    j = a.join(b, path, "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return j.select(path, F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("changed").alias("where"))


def is_transform(consumes: Column, produces: Column) -> Column:
    """Whether a module consumes a type that it also produces."""
    return F.coalesce(F.arrays_overlap(consumes, produces), F.lit(False))
