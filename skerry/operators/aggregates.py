"""Grouped statistics. Order statistics are exact: groups that one task can sort are sorted (which spills), those beyond the hot
bound are bisected by counts or, where every row needs its rank, ranked by running totals over range partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.prefix import running_totals
from skerry.plans.skew import HotKeys, hot_keys, skew_join
from skerry.runtime import Scratch, Written


#: Rows of a group up to which one task sorts it, in a second or two; larger groups are hot.
SORTED = 2_000_000


def zero_filled_counts(df: DataFrame, domain: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per key, 0 for keys of ``domain`` that have none. Keys outside the domain and null keys are left out."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return domain.select(*keys).dropna().distinct().join(counts, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint"))


def conditional_counts(df: DataFrame, group: str, per: str, least: int, domain: DataFrame, out: str = "n") -> DataFrame:
    """For each ``per`` value, how many distinct groups with ``least`` rows or more touch it (0 where none does)."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(group)
    pairs = df.select(group, per).dropna().distinct().join(big, group, "left_semi")
    return zero_filled_counts(pairs, domain, [per], out)


def survival(df: DataFrame, group: Sequence[str], marks: Sequence[int] = (3, 5)) -> DataFrame:
    """Mean, median and maximum of group sizes, and the share of groups with each mark's size or more. One row."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("len"))
    by_len = sizes.groupBy("len").agg(F.count(F.lit(1)).alias("g"))
    q = exact_percentiles(by_len.withColumn("_all", F.lit(1)), ["_all"], "len", {"median_len": 0.5}, weight="g")
    agg = by_len.agg(F.sum("g").alias("groups"), (F.sum(F.col("len") * F.col("g")) / F.sum("g")).alias("mean_len"), F.max("len").alias("max_len"), *[(F.sum(F.when(F.col("len") >= m, F.col("g")).otherwise(0)) / F.sum("g")).alias(f"share_{m}") for m in marks])
    return agg.withColumn("_all", F.lit(1)).join(F.broadcast(q), "_all").drop("_all")  # one row


def cell(x: Column, extent: Column, cells: int) -> Column:
    """Grid cell of a position; the far edge belongs to the last cell."""
    return F.least(F.floor(x / extent * cells), F.lit(cells - 1)).cast("int")


def coverage(df: DataFrame, keys: Sequence[str], x: Column, y: Column, width: Column, height: Column, domain: DataFrame, cells: int = 8) -> DataFrame:
    """Share of the ``cells`` x ``cells`` grid that each key's points touch; 0 for keys without points."""
    at = df.select(*keys, (cell(y, height, cells) * cells + cell(x, width, cells)).alias("_cell")).distinct()
    return zero_filled_counts(at, domain, keys, "_n").select(*keys, (F.col("_n") / (cells * cells)).alias("coverage"))


def _values(df: DataFrame, group: Sequence[str], value: str, weight: str | None) -> DataFrame:
    """(group, v, w) without null and NaN values."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, F.col(value).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).alias("w"))


def _apart(t: Written, group: list[str], hot_floor: int) -> tuple[DataFrame, DataFrame | None, HotKeys]:
    """Rows of ordinary and of hot groups."""
    hot = hot_keys(t.df, group, t.rows, floor=hot_floor) if group else HotKeys(None, [], [])
    if not hot:
        return t.df, None, hot
    key = hot.df.select(*group)
    return t.df.join(key, group, "left_anti"), t.df.join(key, group, "left_semi"), hot


def _sorted(rows: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``before``, the weight of smaller rows of the group (equal values in any order), and ``total``."""
    w = Window.partitionBy(*group)
    before = F.sum("w").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("w").over(w))


#: Parts that an interval of a hot group is cut into in each round, and rows of an interval that are sorted at last.
PARTS, LEFT = 1024, 20_000


def _bisected(rows: DataFrame, group: list[str], targets: DataFrame, s: Scratch) -> DataFrame:
    """(group, target, v): the smallest value at which the running weight of the group passes ``rank``.

    ``targets`` has (group, target, rank) and some rows per hot group. Each round counts, for all groups and targets at once,
    the weight in equal parts of each target's interval (map-side combined), and goes on in the part that holds the
    rank, drawn in to the values that occur there. Nothing is sorted or copied; what is left of an interval when it has few
    rows is sorted.
    """
    bounds = [F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")]
    gs = [f"_g{i}" for i in range(len(group))]
    span = [*group, "lo", "hi"]

    def inside(live: DataFrame) -> DataFrame:
        """Rows in each distinct interval; intervals are those of some targets of hot groups, so few."""
        few = F.broadcast(live.select(*[F.col(g).alias(x) for g, x in zip(group, gs)], "lo", "hi").distinct())
        on = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        for g, x in zip(group, gs):
            on = on & (F.col(g) == F.col(x))
        return rows.join(few, on).drop(*gs)

    state = s.write(targets.join(rows.groupBy(*group).agg(*bounds), group)).df
    done: list[DataFrame] = []
    while True:
        done.append(state.filter("lo = hi").select(*group, "target", F.col("lo").alias("v")))
        few, wide = state.filter(f"lo < hi AND n <= {LEFT}"), state.filter(f"lo < hi AND n > {LEFT}")
        if not few.isEmpty():
            upto = F.sum("w").over(Window.partitionBy(*span).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # LEFT rows at most
            last = s.write(inside(few).withColumn("upto", upto).select(*span, "v", "upto")).df
            done.append(few.join(last, span).filter("upto > rank").groupBy(*group, "target").agg(F.min("v").alias("v")))
        if wide.isEmpty():
            break
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1)).cast("int")
        inner = [F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n")]
        count = inside(wide).groupBy(*span, part.alias("part")).agg(F.sum("w").alias("w"), *inner)
        under = F.coalesce(F.sum("w").over(Window.partitionBy(*span).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # PARTS rows at most
        cut = wide.drop("n").join(count.withColumn("under", under), span).filter("under <= rank AND under + w > rank")
        state = s.write(cut.select(*group, "target", (F.col("rank") - F.col("under")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"), "n")).df
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _position(p: float) -> Column:
    return F.lit(p) * (F.col("total") - 1)


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, wanted: dict[str, float], weight: str | None = None, hot_floor: int = SORTED) -> DataFrame:
    """Exact percentiles with linear interpolation, one column for each entry of ``wanted``. Nulls and NaN do not count.

    ``weight`` names a column of repeat counts. Groups without values have no row; a null key is no group.
    """
    s, group = Scratch(df.sparkSession), list(group)
    t = s.keep(_values(df.dropna(subset=group), group, value, weight))
    cold, hot_rows, hot = _apart(t, group, hot_floor)
    aggs, outs = [], []
    for i, (name, p) in enumerate(wanted.items()):
        pos = _position(p)
        aggs += [F.max(F.when(F.col("before") <= F.floor(pos), F.col("v"))).alias(f"_l{i}"), F.max(F.when(F.col("before") <= F.ceil(pos), F.col("v"))).alias(f"_h{i}"), F.max(pos - F.floor(pos)).alias(f"_f{i}")]
        outs.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(name))
    out = _sorted(cold, group).groupBy(*group).agg(*aggs)
    if hot_rows is not None:
        total = s.write(hot_rows.groupBy(*group).agg(F.sum("w").alias("total"))).df
        ranks = [F.struct(F.lit(2 * i + k).alias("target"), f(_position(p)).cast("bigint").alias("rank")) for i, p in enumerate(wanted.values()) for k, f in enumerate((F.floor, F.ceil))]
        found = _bisected(hot_rows, group, total.select(*group, F.explode(F.array(*ranks)).alias("t")).select(*group, "t.*"), s)
        picked = [F.max(F.when(F.col("target") == 2 * i + k, F.col("v"))).alias(f"_{n}{i}") for i in range(len(wanted)) for k, n in enumerate("lh")]
        wide = found.groupBy(*group).agg(*picked).join(total, group).withColumns({f"_f{i}": _position(p) - F.floor(_position(p)) for i, p in enumerate(wanted.values())})
        out = out.unionByName(wide.select(*out.columns))
    return out.select(*group, *outs)


def weighted_median(df: DataFrame, group: Sequence[str], value: str, weight: str, out: str = "weighted_median", hot_floor: int = SORTED) -> DataFrame:
    """Weighted lower median: the smallest value at which the running weight reaches half of the total.

    Weights at or below 0 and null or NaN weights and values do not count; a null key is no group.
    """
    s, group = Scratch(df.sparkSession), list(group)
    ok = df.dropna(subset=group).filter((F.col(weight) > 0) & ~F.isnan(F.col(weight).cast("double")))
    t = s.keep(_values(ok, group, value, weight))
    cold, hot_rows, hot = _apart(t, group, hot_floor)
    upto = F.sum("w").over(Window.partitionBy(*group).orderBy("v").rangeBetween(Window.unboundedPreceding, 0))
    half = cold.withColumn("upto", upto).withColumn("total", F.sum("w").over(Window.partitionBy(*group)))
    got = half.groupBy(*group).agg(F.min(F.when(F.col("upto") >= 0.5 * F.col("total"), F.col("v"))).alias(out))
    if hot_rows is not None:
        # reaching half is passing anything below it; half a unit in the last place keeps sums of doubles on one side
        total = hot_rows.groupBy(*group).agg(F.sum("w").cast("double").alias("total"))
        target = total.select(*group, F.lit(0).alias("target"), (0.5 * F.col("total") * (1 - 1e-15)).alias("rank"))
        got = got.unionByName(_bisected(hot_rows, group, s.write(target).df, s).select(*group, F.col("v").alias(out)))
    return got


def spread_measures(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Median, median absolute deviation, robust coefficient of variation (1.4826 MAD / |median|) and interquartile range."""
    s, group = Scratch(df.sparkSession), list(group)
    src = s.keep(df.dropna(subset=group).select(*group, F.col(value).alias("_v")))
    q = s.write(exact_percentiles(src.df, group, "_v", {"median": 0.5, "_q1": 0.25, "_q3": 0.75}))
    dev = skew_join(src.df, q.df.select(*group, "median"), group, "inner", hot_keys(src.df, group, src.rows)).select(*group, F.abs(F.col("_v") - F.col("median")).alias("_d"))
    mad = exact_percentiles(dev, group, "_d", {"mad": 0.5})
    return s.settle(q.df.join(mad, group).select(*group, "median", "mad", F.try_divide(1.4826 * F.col("mad"), F.abs("median")).alias("robust_cv"), (F.col("_q3") - F.col("_q1")).alias("iqr")), q, src)


def by_support(df: DataFrame, size: str, value: str, top: int = 5, low: int = 2) -> DataFrame:
    """Count and median of ``value`` by support ``low`` .. ``top`` and more; buckets without rows have count 0."""
    b = df.filter(F.col(size) >= low).select(F.least(F.col(size), F.lit(top)).cast("int").alias("bucket"), F.col(value).alias("_v"))
    buckets = df.sparkSession.range(low, top + 1).select(F.col("id").cast("int").alias("bucket"))
    med = exact_percentiles(b, ["bucket"], "_v", {"median": 0.5})
    return zero_filled_counts(b, buckets, ["bucket"], "points").join(med, "bucket", "left")


def both_ends_rollup(df: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """Pairs rolled up by member, each pair counting for both: pairs scored, median and worst value."""
    ends = df.select(F.explode(F.array(F.col(left), F.col(right))).alias("member"), F.col(value).alias("_v")).filter(F.col("member").isNotNull() & F.col("_v").isNotNull())
    n = ends.groupBy("member").agg(F.count(F.lit(1)).alias("pairs"), F.max("_v").alias("worst"))
    return n.join(exact_percentiles(ends, ["member"], "_v", {"median": 0.5}), "member", "left")


def mid_rank_percentile(df: DataFrame, group: Sequence[str], item: str, value: str, lower_better: bool = False, out: str = "pct", hot_floor: int = SORTED) -> DataFrame:
    """``100 (below + half the equals) / n`` of each row's value within its group; inverted where less is better.

    Null and NaN values have null, and so have rows with a null key. Rows of hot groups are ranked by running totals over
    range partitions.
    """
    s, group = Scratch(df.sparkSession), list(group)
    src = s.keep(df.select(*group, item, F.col(value).cast("double").alias("v")))
    known = F.col("v").isNotNull() & ~F.isnan("v")
    for g in group:
        known = known & F.col(g).isNotNull()
    cold, hot_rows, hot = _apart(src, group, hot_floor)
    same = Window.partitionBy(*group, known.alias("_known"))
    rank = (F.rank().over(same.orderBy("v")) - 1 + 0.5 * F.count(F.lit(1)).over(Window.partitionBy(*group, known.alias("_known"), "v"))) / F.count(F.lit(1)).over(same)
    got = cold.withColumn("_p", F.when(known, 100 * rank))
    if hot_rows is not None:
        counted = hot_rows.filter(known).groupBy(*group, "v").agg(F.count(F.lit(1)).alias("w"))
        t, stored = running_totals(counted, group, ["v"], "w", "before", s)
        total = F.broadcast(stored.df.groupBy(*group).agg(F.sum("w").alias("total")))  # hot groups
        ranks = s.write(t.join(total, group).select(*group, "v", (100 * (F.col("before") + 0.5 * F.col("w")) / F.col("total")).alias("_p")))
        h = s.write(hot_rows)
        got = got.unionByName(skew_join(h.df, ranks.df, [*group, "v"], "left", hot_keys(h.df, [*group, "v"], h.rows)).select(*got.columns))
    return got.select(*group, item, F.col("v").alias(value), (100 - F.col("_p") if lower_better else F.col("_p")).alias(out))


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with averaged ties. Rows with a gap in either value are left out."""
    s, group = Scratch(df.sparkSession), list(group)
    src = s.write(df.select(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().withColumn("_i", F.monotonically_increasing_id()))
    a = mid_rank_percentile(src.df, group, "_i", "x", out="px").select("_i", *group, "px")
    b = mid_rank_percentile(src.df, group, "_i", "y", out="py").select("_i", "py")
    return a.join(b, "_i").groupBy(*group).agg(F.corr("px", "py").alias("rho"))


def weakest_rung(df: DataFrame, item: str, rungs: Sequence[str]) -> DataFrame:
    """The reading with the least percentile; the first of ``rungs`` where equal, null where all are null."""
    least = F.least(*[F.col(r) for r in rungs]) if len(rungs) > 1 else F.col(rungs[0])
    which = F.coalesce(*[F.when(F.col(r) == least, F.lit(r)) for r in rungs])
    return df.select(item, which.alias("weakest"), least.alias("pct"))


def ranking_tally(df: DataFrame, group: str, item: str, truth: str, readings: Sequence[str]) -> DataFrame:
    """How often a reading orders two items of a group as the truth does (less is better in the truth, more in the reading).

    Pairs with equal truth do not count; a reading that is equal or missing makes the pair unevaluable. Works from the
    sorted order of each item against all others of its group, for groups of bounded size such as the legs of a
    comparison.
    """
    a = df.select(F.col(group), F.col(item).alias("_i"), F.col(truth).alias("_t"), *[F.col(r).alias(f"_{k}") for k, r in enumerate(readings)])
    b = a.select(F.col(group), *[F.col(c).alias(f"{c}2") for c in a.columns if c != group])
    p = a.join(b, group).filter("_i < _i2 AND _t <> _t2")
    outs = []
    for k, r in enumerate(readings):
        d = (F.col(f"_{k}") - F.col(f"_{k}2")) * (F.col("_t2") - F.col("_t"))
        outs.append(F.struct(F.lit(r).alias("reading"), F.count_if(d > 0).alias("right"), F.count_if(d < 0).alias("wrong"), F.count_if(d.isNull() | (d == 0)).alias("unevaluable")).alias(f"r{k}"))
    return p.agg(*outs).select(F.explode(F.array(*[f"r{k}" for k in range(len(readings))])).alias("r")).select("r.*")


def series_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, least, median and greatest of a series, gaps left out."""
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest")).join(exact_percentiles(ok, keys, value, {"median": 0.5}), list(keys))


def distribution_table(df: DataFrame, readings: Sequence[str]) -> DataFrame:
    """n, least, median and greatest of each reading: a reference distribution."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(r).alias("reading"), F.col(r).cast("double").alias("v")) for r in readings])).alias("r")).select("r.*")
    return series_summary(long, ["reading"], "v")


def asymmetric_ewma(df: DataFrame, key: str, order: Sequence[str], value: str, up: float = 0.6, down: float = 0.2) -> DataFrame:
    """Order-dependent running estimate: moves by ``up`` of the gap towards larger values and by ``down`` towards smaller.

    Rows of a key are streamed through one task in order with one number of state; nothing is gathered. Null values are
    skipped. Returns the last estimate and the number of values.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, est, n = None, 0.0, 0
        for p in parts:
            done = []
            for k, v in zip(p["k"].tolist(), p["v"].tolist()):
                if n and k != key_now:
                    done.append((key_now, est, n))
                    n = 0
                if not n:
                    key_now, est = k, v
                else:
                    est += (up if v > est else down) * (v - est)
                n += 1
            if done:
                yield pd.DataFrame(done, columns=["k", "estimate", "n"])
        if n:
            yield pd.DataFrame([(key_now, est, n)], columns=["k", "estimate", "n"])

    src = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    kind = src.schema["k"].dataType.simpleString()
    return src.repartition("k").sortWithinPartitions("k", *[f"o{i}" for i in range(len(order))]).select("k", "v").mapInPandas(run, f"k {kind}, estimate double, n bigint").withColumnRenamed("k", key)


def histogram(df: DataFrame, keys: Sequence[str], value: str, least: float, most: float, bins: int) -> DataFrame:
    """Normalised histogram: (keys, bin, share); values outside the range fall into the end bins."""
    width = (most - least) / bins
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - least) / width))).cast("int")
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    total = c.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    return c.join(total, list(keys)).select(*keys, "bin", (F.col("_n") / F.col("_t")).alias("share"))


def histogram_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bhattacharyya distance of two (bin, share) histograms, as a one-row DataFrame."""
    j = a.select("bin", F.col("share").alias("p")).join(b.select("bin", F.col("share").alias("q")), "bin")
    return j.agg(F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(F.col("p") * F.col("q"))))).alias("distance"))
