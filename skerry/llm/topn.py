"""The N best items of every group, by simultaneous bisection of all groups' cutoffs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.skew import HOT_FLOOR, hot_keys, skew_join
from skerry.runtime import Scratch

#: Midpoints per round: each round refines a cutoff as far as log2(MIDPOINTS) halvings do.
MIDPOINTS = 256


@dataclass(frozen=True)
class Order:
    """One column of the order. ``largest`` first or smallest; ``gaps``: nulls and NaN come last, or take no part."""

    column: str
    largest: bool = True
    gaps: str = "last"


def _code(df: DataFrame, order: Sequence[Order], item: str) -> list[Column]:
    """The order-preserving code: components, larger is better, compared one after another.

    A number gives two components: its class (gap, -inf, finite, +inf) and its finite value; the item comes last, the
    smallest first, and makes the code unique.
    """
    out: list[Column] = []
    for o in order:
        c = F.col(o.column)
        if df.schema[o.column].dataType.typeName() in ("double", "float"):
            v = (c.cast("double") if o.largest else -c.cast("double")) + F.lit(0.0)
            gap = v.isNull() | F.isnan(v)
            finite = ~gap & (F.abs(v) < F.lit(float("inf")))
            out.append(F.when(gap, 0).when(finite, 2).when(v > 0, 3).otherwise(1).cast("bigint"))
            out.append(F.when(finite, v).otherwise(F.lit(0.0)))
        else:
            v = c.cast("bigint")
            out.append(F.when(v.isNull(), 0).otherwise(1).cast("bigint"))
            # -1 - v turns the order of whole numbers without overflow
            out.append(F.coalesce(v if o.largest else -1 - v, F.lit(0).cast("bigint")))
    out.append(-1 - F.col(item).cast("bigint"))
    return out


def _bucket(x: Column, lo: Column, hi: Column, floating: bool) -> Column:
    """Which of MIDPOINTS equal parts of [lo, hi] a component falls into: lo in the first, hi in the last, never decreasing."""
    if floating:
        wide = (hi - lo) == F.lit(float("inf"))
        part = F.when(wide, (x / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise((x - lo) / (hi - lo))
    else:
        span = F.try_subtract(hi, lo).cast("double")
        near = F.try_subtract(x, lo).cast("double") / span
        far = (x.cast("double") / 2 - lo.cast("double") / 2) / (hi.cast("double") / 2 - lo.cast("double") / 2)
        part = F.when(span.isNotNull(), near).otherwise(far)
    return F.least(F.floor(part * MIDPOINTS), F.lit(MIDPOINTS - 1)).cast("int")


def top_n(df: DataFrame, group: str, order: Sequence[Order], item: str, n: int, hot_floor: int = HOT_FLOOR) -> DataFrame:
    """``group, place, item``: the first ``n`` items of each group in the given order, then by smallest item.

    Method: every group has an interval of the code that holds its cutoff. A round counts, for all groups at once, the rows
    between MIDPOINTS equally spaced points of the interval (partial aggregation, so a hot group sends at most MIDPOINTS
    counts per task), keeps what lies above the part in which the n-th row must be, drops what lies below, and goes on with
    the rows in that part. It ends when every group holds exactly n. Rows still undecided shrink about MIDPOINTS-fold per
    round, and an interval is drawn in to the smallest and largest code that really occur, so empty stretches cost nothing.

    Defined cases: rows with null group or item take no part; nor do rows with a gap (null or NaN) in a column with
    ``gaps="out"``, else gaps come last; repeated rows (same group, order values and item) count once; a group with fewer
    items has fewer rows; ``n`` below 1 or an empty table gives an empty result; extra columns are ignored. Infinities
    take their place in the order. The item is a whole number.
    """
    if n < 1:
        return df.select(F.col(group).alias(group), F.lit(0).alias("place"), F.col(item).alias(item)).limit(0)
    s = Scratch(df.sparkSession)
    src = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    for o in order:
        if o.gaps == "out":
            c = F.col(o.column)
            src = src.filter(c.isNotNull() & (~F.isnan(c) if df.schema[o.column].dataType.typeName() in ("double", "float") else F.lit(True)))
    codes = _code(df, order, item)
    ks = [f"k{i}" for i in range(len(codes))]
    rows = s.write(src.select(F.col(group).alias("g"), *[c.alias(k) for c, k in zip(codes, ks)]).distinct())
    floating = {f.name for f in rows.df.schema if f.dataType.typeName() == "double"}
    bounds = [f(k).alias(f"{p}{k}") for k in ks for p, f in (("lo_", F.min), ("hi_", F.max))]
    ends = [f"{p}{k}" for k in ks for p in ("lo_", "hi_")]
    hot = hot_keys(rows.df, ["g"], rows.rows, floor=hot_floor)

    def part() -> Column:
        """The part of its interval a row falls into, by the first component that differs within the interval."""
        out = F.lit(0)
        for i in reversed(range(len(ks))):
            lo, hi = F.col(f"lo_{ks[i]}"), F.col(f"hi_{ks[i]}")
            out = F.when(lo < hi, _bucket(F.col(ks[i]), lo, hi, ks[i] in floating)).otherwise(out)
        return out

    def narrowed(t: DataFrame, cut: DataFrame) -> DataFrame:
        """Rows at or above their group's cutoff part. ``need``: null if chosen, else how many are still wanted in the interval."""
        cut = s.write(cut).df if hot else cut
        j = skew_join(t, cut, ["g"], "inner", hot).filter("b >= cut")
        wanted = F.when((F.col("b") == F.col("cut")) & (F.col("left") < F.col("n")), F.col("left"))
        return j.select("g", *ks, wanted.alias("need"), F.when(wanted.isNotNull(), part()).alias("b"))

    sizes = rows.df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *bounds)
    t = s.write(narrowed(rows.df.withColumn("b", F.lit(0)), sizes.select("g", F.lit(0).alias("cut"), F.lit(n).cast("bigint").alias("left"), "n", *ends)))
    s.drop(rows)
    chosen = [t.df.filter("need IS NULL")]
    while not (still := t.df.filter("need IS NOT NULL")).isEmpty():
        counts = still.groupBy("g", "b").agg(F.first("need").alias("need"), F.count(F.lit(1)).alias("n"), *bounds)
        above = Window.partitionBy("g").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # at most MIDPOINTS rows
        cut = counts.withColumn("over", F.coalesce(F.sum("n").over(above), F.lit(0))).filter("over < need AND over + n >= need")
        t = s.write(narrowed(still.drop("need"), cut.select("g", F.col("b").alias("cut"), (F.col("need") - F.col("over")).alias("left"), "n", *ends)))
        chosen.append(t.df.filter("need IS NULL"))
    won = chosen[0]
    for x in chosen[1:]:
        won = won.unionByName(x)
    place = F.row_number().over(Window.partitionBy("g").orderBy(*[F.desc(k) for k in ks]))  # n rows a group
    return won.select(F.col("g").alias(group), place.cast("int").alias("place"), (-1 - F.col(ks[-1])).cast(df.schema[item].dataType).alias(item))
