"""Rows chosen within groups, renumbering, and order-based windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.prefix import dense_ids
from skerry.runtime import Scratch


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, which should be total; ``rank`` adds the place.

    Spark cuts every group down to ``k`` rows in each partition before the shuffle, so a hot group sends at most ``k`` rows a
    task. The column ``_r`` is taken by the operator.
    """
    got = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= k)
    return got.withColumnRenamed("_r", rank) if rank else got.drop("_r")


def best_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, group, order, 1)


def even_positions(n: Column, k: int, nearest: bool = False) -> Column:
    """``k`` evenly spaced positions of 0 .. n-1, truncated or rounded half to even; all of them where n <= k."""
    step = (n - 1) / F.lit(max(k - 1, 1))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.rint(i * step) if nearest else F.floor(i * step)).cast("bigint"))
    return F.when(n <= k, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array_distinct(at))


def even_sample(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int, nearest: bool = False) -> DataFrame:
    """Every group thinned to ``k`` rows at even steps of its order. Positions come from distributed running totals."""
    from skerry.plans.prefix import running_totals

    s, group = Scratch(df.sparkSession), list(group)
    pos, stored = running_totals(df.dropna(subset=group).withColumn("_one", F.lit(1)), group, list(order), "_one", "_pos", s)
    sizes = stored.df.groupBy(*group).agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
    keep = sizes.select(*group, F.explode(even_positions(F.col("_n"), k, nearest)).alias("_pos"))
    return pos.withColumn("_pos", F.col("_pos").cast("bigint")).join(keep, [*group, "_pos"]).drop("_pos", "_one")


def hash_sample(df: DataFrame, key: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """``k`` rows in the order of a seeded hash of the key: the same rows on every run and any partitioning."""
    return df.withColumn("_h", F.xxhash64(*key, F.lit(seed))).orderBy("_h", *key).limit(k).drop("_h")


def nearest_to_centre(df: DataFrame, frame: str, centre: float, k: int) -> DataFrame:
    return df.withColumn("_d", F.abs(F.col(frame) - centre)).orderBy("_d", frame).limit(k).drop("_d").orderBy(frame)


def renumber(df: DataFrame, key: str, out: str) -> DataFrame:
    """Dense numbers 0, 1, ... in the order of the distinct non-null keys, joined back to every row."""
    ids, _ = dense_ids(df.select(key).dropna().distinct(), out, Scratch(df.sparkSession))
    return df.join(ids, key, "left")


def repeated_in_group(df: DataFrame, group: Sequence[str], frame: str, order: str, out: str = "repeated") -> DataFrame:
    """Flags rows whose (group, frame) came before, in ``order``."""
    w = Window.partitionBy(*group, frame).orderBy(order)
    return df.withColumn(out, F.row_number().over(w) > 1)


def sequence_check(df: DataFrame, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Whether trailing numbers of names rise strictly, and how dense they are (numbers / span).

    Strict rise over the sorted distinct numbers means no number repeats; names without a number make it false.
    """
    n = F.expr(f"try_cast(regexp_extract({name}, '([0-9]+)[^0-9]*$', 1) AS bigint)")
    a = df.select(*group, n.alias("_n"))
    agg = a.groupBy(*group) if group else a.groupBy()
    return agg.agg((F.count_distinct("_n") == F.count(F.lit(1))).alias("ordered"), F.try_divide(F.count_distinct("_n").cast("double"), F.max("_n") - F.min("_n") + 1).alias("density"))


def last_n(df: DataFrame, group: Sequence[str], seq: str, n: int) -> DataFrame:
    return top_k(df, group, [F.desc(seq)], n)


def spread_keypoints(df: DataFrame, image: str, idx: str, score: str, x: str, y: str, k: int, largest: float, rounds: int = 12) -> DataFrame:
    """About ``k`` strong points of each image, spread out: the strongest of each grid cell, the cell size found per image
    by bisection (largest cell that still leaves k points). All images bisect at once."""
    s = Scratch(df.sparkSession)
    pts = s.write(df.select(F.col(image).alias("g"), F.col(idx).alias("i"), F.col(score).alias("s"), F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["g", "i"]))
    state = s.write(pts.df.select("g").distinct().select("g", F.lit(0.0).alias("lo"), F.lit(float(largest)).alias("hi")))
    mid = (F.col("lo") + F.col("hi")) / 2
    for _ in range(rounds):
        cells = pts.df.join(state.df, "g").select("g", F.floor(F.col("x") / mid).alias("cx"), F.floor(F.col("y") / mid).alias("cy")).distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        state = s.write(state.df.join(cells, "g").select("g", F.when(F.col("n") >= k, mid).otherwise(F.col("lo")).alias("lo"), F.when(F.col("n") >= k, F.col("hi")).otherwise(mid).alias("hi")))
    size = F.when(F.col("lo") > 0, F.col("lo"))
    best = F.max_by("i", F.struct(F.col("s"), -F.col("i")))
    cut = pts.df.join(state.df, "g").groupBy("g", F.coalesce(F.floor(F.col("x") / size), F.col("i")).alias("cx"), F.coalesce(F.floor(F.col("y") / size), F.lit(0)).alias("cy")).agg(best.alias("i"))
    return cut.select(F.col("g").alias(image), F.col("i").alias(idx))
