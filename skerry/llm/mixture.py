"""A mixture of sources by target shares of the total size, with a cap on repeats."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.plans.prefix import running_totals
from skerry.runtime import Scratch


@dataclass(frozen=True)
class Budget:
    """What a source gives: whole epochs, then ``rest`` of its size from one more epoch."""

    source: str
    target_share: float
    max_repeats: int
    size: int
    budget: float
    epochs: int
    rest: float


def budgets(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: float | None = None) -> list[Budget]:
    """Sizes to take from each source.

    Sources that have no records give nothing, and the others share the whole in proportion to their targets. Without
    ``total`` the mixture is as large as it can be with every source exactly at its share: the source that runs out first
    (size times repeats against share) sets the total. With a larger ``total``, a source that cannot fill its part gives all
    it may, and what it lacks is spread over the others by their targets, again and again until it fits or all are used up;
    these are the nearest shares that the caps allow.

    Targets below or equal to 0, null sources and repeats below 1 take no part; of repeated sources the first counts.
    """
    plan: dict[str, tuple[float, int]] = {}
    for source, share, repeats in targets:
        if source is not None and share is not None and share > 0 and (repeats or 0) >= 1 and source not in plan:
            plan[source] = (float(share), int(repeats))
    live = {s: plan[s] for s in plan if sizes.get(s, 0) > 0}
    cap = {s: sizes[s] * r for s, (_, r) in live.items()}
    give: dict[str, float] = dict.fromkeys(live, 0.0)
    if live:
        whole = sum(t for t, _ in live.values())
        if total is None:
            total = min(cap[s] * whole / live[s][0] for s in live)
        free, left = dict(live), float(total)
        while free:
            share = sum(t for t, _ in free.values())
            full = [s for s, (t, _) in free.items() if left * t / share >= cap[s] * (1 - 1e-12)]
            if not full:
                give |= {s: left * t / share for s, (t, _) in free.items()}
                break
            for s in full:
                give[s] = float(cap[s])
            left -= sum(cap[s] for s in full)
            free = {s: v for s, v in free.items() if s not in full}
            if left <= 0:
                break
    out = []
    for s, (t, r) in plan.items():
        b, size = give.get(s, 0.0), sizes.get(s, 0)
        epochs = min(r, math.floor(b / size + 1e-12)) if size else 0
        out.append(Budget(s, t, r, size, b, epochs, max(0.0, b - epochs * size) if epochs < r else 0.0))
    return out


def mix(records: DataFrame, targets: DataFrame, source: str, item: str, size: str, total: float | str | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(records with ``copies``, report).

    Every record gets a random key, a hash of its item and the seed. Within each source records are range-sorted by that
    key, distributed running totals of their sizes tell where each one stands, and the source is cut at its budget: a record
    is taken while its middle lies within, so the sum misses the budget by at most half a record. Whole epochs come before
    that cut and add one copy of every record each.

    ``total`` is as in :func:`budgets`, or ``"available"``: as large as all records of sources with a target, each once.

    The report has one row per target: ``source, target_share, max_repeats, available, budget, taken, actual_share``; target
    and budget shares are of the whole mixture. Targets are few (one row per source, read by the driver); the number of
    records and the size of a source are unbounded.

    Defined cases: records with null item, source or size, with size 0 or below, or of a source without target are left out;
    repeated items count once, with their largest size; a target without records has 0 taken; empty tables give an empty
    mixture and 0 shares; extra columns are ignored.
    """
    spark = records.sparkSession
    s = Scratch(spark)
    rows = records.select(F.col(source).alias("source"), F.col(item).alias("item"), F.col(size).cast("bigint").alias("size"))
    want = [(r[0], r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").collect()]
    names = sorted({w[0] for w in want if w[0] is not None})
    rows = rows.filter(F.col("item").isNotNull() & (F.col("size") > 0) & F.col("source").isin(names)).groupBy("source", "item").agg(F.max("size").alias("size"))
    t = s.write(rows.withColumn("key", F.xxhash64("item", F.lit(seed))))
    sizes = {r[0]: int(r[1]) for r in t.df.groupBy("source").agg(F.sum("size")).collect()}
    plan = budgets(want, sizes, float(sum(sizes.values())) if total == "available" else total)
    before, _ = running_totals(t.df, ["source"], ["key", "item"], "size", "before", s)
    cut = spark.createDataFrame([(b.source, b.epochs, b.rest) for b in plan], "source string, epochs int, rest double")
    j = before.join(F.broadcast(cut), "source")  # one row per target
    one_more = (F.col("before") + F.col("size") / 2 <= F.col("rest")).cast("int")
    taken = s.write(j.select(F.col("item").alias(item), "source", "size", (F.col("epochs") + one_more).alias("copies")).filter("copies > 0"))
    got = taken.df.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    table = spark.createDataFrame([(b.source, b.target_share, b.max_repeats, b.size, b.budget) for b in plan], "source string, target_share double, max_repeats int, available bigint, budget double")
    report = F.broadcast(table).join(got, "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    whole = report.agg(F.sum("taken").alias("_whole"))
    report = report.join(F.broadcast(whole)).select("source", "target_share", "max_repeats", "available", F.round("budget", 3).alias("budget"), "taken", F.round(F.coalesce(F.try_divide("taken", "_whole"), F.lit(0.0)), 6).alias("actual_share"))
    return taken.df, report
