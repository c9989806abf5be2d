"""Running totals and dense numbering over data of any size, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.runtime import Scratch, Written


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, scratch: Scratch) -> tuple[DataFrame, Written]:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before this one in ``order``.

    Rows are range-partitioned by (group, order), so a hot group spreads over many partitions; ``order`` must be unique
    in its group. Inside a partition an ordinary window runs (bounded by the partition). Only a group that crosses a
    partition border needs an offset, at most two per partition, and those few rows are broadcast.
    """
    group, order = list(group), list(order)
    t = scratch.write(df.repartitionByRange(*[F.col(c) for c in group + order]).withColumn("_pid", F.spark_partition_id()))
    seg = t.df.groupBy("_pid", *group).agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*group).orderBy("_pid")
    offsets = (
        seg.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*group)))
        .filter("_parts > 1")
        .withColumn("_off", F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_off")
    )
    inner = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cond = F.col("_pid") == F.col("_p")
    for i, c in enumerate(group):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    res = t.df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(F.broadcast(offsets), cond, "left")
    return res.withColumn(out, F.col("_in") + F.coalesce(F.col("_off"), F.lit(0))).select(*df.columns, out), t


def dense_ids(keys: DataFrame, out: str, scratch: Scratch) -> tuple[DataFrame, Written]:
    """Numbers distinct rows 0, 1, 2, ... in their sort order; ``keys`` must hold each row once."""
    cols = keys.columns
    t = scratch.write(keys.repartitionByRange(*[F.col(c) for c in cols]).withColumn("_pid", F.spark_partition_id()))
    # one row per partition
    n = t.df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    off = n.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("_pid").orderBy(*cols)
    res = t.df.withColumn("_r", F.row_number().over(w)).join(F.broadcast(off.select("_pid", "_off")), "_pid")
    return res.select(*cols, (F.col("_off") + F.col("_r") - 1).cast("bigint").alias(out)), t
