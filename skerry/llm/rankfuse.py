"""One ranking from several scores of unlike scale: percentiles with averaged ties, normal scores, weighted mean."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.prefix import running_totals
from skerry.plans.skew import HOT_FLOOR, hot_keys, skew_join
from skerry.runtime import Scratch

#: Partial sums of normal scores are rounded to this many places before they are compared, so that equal items stay equal
#: whatever the order of summation.
PLACES = 9


@dataclass(frozen=True)
class Score:
    column: str
    more_is_better: bool = True
    weight: float = 1.0


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution; the few distinct percentiles of a batch are computed once each."""

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        inv = NormalDist().inv_cdf
        u, at = np.unique(p.to_numpy(dtype=float), return_inverse=True)
        return pd.Series(np.array([inv(x) for x in u], dtype=float)[at])

    return quantile(p)


def _value(df: DataFrame, s: Score) -> Column:
    """Larger is better; a gap (null or NaN) is minus infinity, so below all values and equal to other gaps."""
    c = F.col(s.column).cast("double")
    v = F.when(c.isNull() | F.isnan(c), None).otherwise(c if s.more_is_better else -c)
    # adding 0.0 makes -0.0 and 0.0 one value
    return F.coalesce(v + F.lit(0.0), F.lit(float("-inf")))


def fused_scores(df: DataFrame, group: Sequence[str], item: str, scores: Sequence[Score], hot_floor: int = HOT_FLOOR) -> DataFrame:
    """``group, item, fused``: the weighted mean of the item's normal scores within its group.

    A score's percentile is (number below + half the number of equals) / group size, which is (average rank - 1/2) / n.
    Groups below the hot bound are ranked by windows, each group in one task. Hot groups (fewer than ``HOT_SHARE``, see
    :mod:`skerry.plans.skew`) are ranked in a distributed way: equal values are counted first, and running totals over
    range partitions give the number below. Both give the same numbers.

    Defined cases: a null or NaN score is the worst of its group, equal to other gaps; rows with a null item or group key are
    left out; rows repeated with the same scores count once, and of an item with different scores the row with the
    greatest scores, compared in the given order, counts; a single item has percentile 1/2; an empty table gives an
    empty result; extra columns are ignored.
    """
    group = list(group)
    s = Scratch(df.sparkSession)
    vals = [f"v{i}" for i in range(len(scores))]
    src = df.dropna(subset=[*group, item]).select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col(item).alias("item"), *[_value(df, x).alias(v) for x, v in zip(scores, vals)])
    gs = [f"g{i}" for i in range(len(group))]
    rows = s.write(src.groupBy(*gs, "item").agg(F.max(F.struct(*vals)).alias("_b")).select(*gs, "item", *[F.col(f"_b.{v}").alias(v) for v in vals]))
    hot = hot_keys(rows.df, gs, rows.rows, floor=hot_floor)
    cold = rows.df.join(hot.df.select(*gs), gs, "left_anti") if hot else rows.df
    size = F.count(F.lit(1)).over(Window.partitionBy(*gs))
    pcts = []
    for v in vals:
        below = F.rank().over(Window.partitionBy(*gs).orderBy(v)) - 1
        ties = F.count(F.lit(1)).over(Window.partitionBy(*gs, v))
        pcts.append(((below + ties / 2) / size).alias(v))
    parts = [cold.select(*gs, "item", *pcts)]
    if hot:
        parts.append(_hot_percentiles(rows.df.join(hot.df.select(*gs), gs, "left_semi"), gs, vals, s, rows.rows, hot_floor))
    pct = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    total = float(sum(x.weight for x in scores))
    fused = sum((normal_quantile(F.col(v)) * F.lit(x.weight / total) for v, x in zip(vals, scores)), F.lit(0.0))
    return pct.select(*[F.col(a).alias(b) for a, b in zip(gs, group)], F.col("item").alias(item), F.round(fused, PLACES).alias("fused"))


def _hot_percentiles(rows: DataFrame, gs: list[str], vals: list[str], s: Scratch, n: int, floor: int) -> DataFrame:
    long = s.write(rows.select(*gs, "item", F.explode(F.map_from_arrays(F.array(*[F.lit(i) for i in range(len(vals))]), F.array(*vals))).alias("which", "v")))
    counted = long.df.groupBy(*gs, "which", "v").agg(F.count(F.lit(1)).alias("ties"))
    below, _ = running_totals(counted, [*gs, "which"], ["v"], "ties", "below", s)
    sizes = F.broadcast(long.df.filter("which = 0").groupBy(*gs).agg(F.count(F.lit(1)).alias("size")))  # one row for each hot group
    pct = s.write(below.join(sizes, gs).select(*gs, "which", "v", ((F.col("below") + F.col("ties") / 2) / F.col("size")).alias("p")))
    key = [*gs, "which", "v"]
    back = skew_join(long.df, pct.df, key, "inner", hot_keys(long.df, key, n, floor=floor))
    return back.groupBy(*gs, "item").agg(*[F.max(F.when(F.col("which") == i, F.col("p"))).alias(v) for i, v in enumerate(vals)])
