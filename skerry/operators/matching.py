"""Nearest-neighbour matching between images, pair lists, and one-to-one matching."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.plans.skew import hot_keys
from skerry.runtime import Scratch

#: Rows of either side that one distance block holds.
BLOCK = 2048


def band_pairs(images: DataFrame, count: str, scope: Sequence[str] = (), window: int | None = None) -> DataFrame:
    """``scope, i, j``, i < j: all pairs of the images 0 .. count-1 of each scope, or those at most ``window`` apart.

    Written out image by image, without a join; the result has that size by definition.
    """
    f = images.select(*scope, F.col(count).cast("bigint").alias("_n")).filter("_n > 1").select(*scope, "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 2)).alias("i"))
    return f.select(*scope, "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("i") + window, F.col("_n") - 1) if window else F.col("_n") - 1)).alias("j"))


def stride_pairs(images: DataFrame, count: str, stride: int, scope: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """``scope, i, j``: images ``stride`` apart; thinned evenly to ``most`` pairs a scope if given (a sampling operator)."""
    from skerry.operators.selection import even_positions

    n = F.greatest(F.col(count).cast("bigint") - stride, F.lit(0).cast("bigint"))
    at = even_positions(n, most) if most else F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))
    return images.filter(F.col(count) > stride).select(*scope, F.explode(at).alias("i")).withColumn("j", F.col("i") + stride)


def knn2(queries: DataFrame, targets: DataFrame, qid: str, tid: str, vector: str, pair: str | None = None, hamming: bool = False) -> DataFrame:
    """``[pair,] qid, t1, d1, t2, d2``: the two nearest targets of each query (ties: smaller id), by blocks of vectors.

    Queries of a ``pair`` meet that pair's targets only. Both sides are cut into blocks of at most ``BLOCK`` vectors by a
    hash of their id; a task holds one block of each and multiplies them as matrices, so no group is ever gathered whole,
    and only two candidates per query and block travel on. This is the exact search: its work is queries x targets.
    """
    keys = [F.col(pair).alias("pair")] if pair else [F.lit(0).alias("pair")]
    q = queries.filter(F.col(vector).isNotNull()).select(*keys, F.col(qid).alias("id"), F.col(vector).alias("v"))
    t = targets.filter(F.col(vector).isNotNull()).select(*keys, F.col(tid).alias("id"), F.col(vector).alias("v"))
    # blocks per pair, from the sizes of both sides
    nq = q.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nq"))
    nt = t.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nt"))
    grid = nq.join(nt, "pair")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = q.join(grid, "pair").select("pair", block("nq").alias("bq"), F.explode(F.sequence(F.lit(0), F.col("nt") - 1)).alias("bt"), "id", "v")
    right = t.join(grid, "pair").select("pair", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"), block("nt").alias("bt"), "id", "v")
    pt = q.schema["pair"].dataType.simpleString()
    it, jt = q.schema["id"].dataType.simpleString(), t.schema["id"].dataType.simpleString()

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["pair", "q", "t1", "d1", "t2", "d2"]
        if not a.num_rows or not b.num_rows:
            return pa.table({n: [] for n in names}).cast(schema)
        b = b.sort_by("id")
        ids = b.column("id")
        x, y = (np.asarray(z.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(z.num_rows, -1) for z in (a, b))
        if hamming:
            d = np.stack([np.abs(y - r).sum(axis=1) for r in x])
        else:
            d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
        k = min(2, len(y))
        # ids are sorted, so the first of equal distances is the smaller id
        order = np.empty((len(x), k), np.int64)
        best = np.empty((len(x), k))
        at = np.arange(len(x))
        for j in range(k):
            order[:, j] = d.argmin(axis=1)
            best[:, j] = d[at, order[:, j]]
            d[at, order[:, j]] = np.inf
        if not hamming:
            best = np.sqrt(((x[:, None, :] - y[order]) ** 2).sum(axis=2))
        cols = {"pair": a.column("pair"), "q": a.column("id"), "t1": ids.take(pa.array(order[:, 0])), "d1": pa.array(best[:, 0])}
        cols["t2"] = ids.take(pa.array(order[:, 1])) if k == 2 else pa.nulls(len(x), ids.type)
        cols["d2"] = pa.array(best[:, 1]) if k == 2 else pa.nulls(len(x), pa.float64())
        return pa.table(cols).cast(schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"pair {pt}, q {it}, t1 {jt}, d1 double, t2 {jt}, d2 double"
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    key = ["pair", "bq", "bt"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, ddl)
    cand = found.select("pair", "q", F.explode(F.array(F.struct(F.col("d1").alias("d"), F.col("t1").alias("t")), F.struct(F.col("d2").alias("d"), F.col("t2").alias("t")))).alias("c")).filter("c.t IS NOT NULL")
    # two candidates per block: short lists
    two = cand.groupBy("pair", "q").agg(F.slice(F.array_sort(F.collect_list("c")), 1, 2).alias("b"))
    out = two.select("pair", F.col("q").alias(qid), F.col("b")[0]["t"].alias("t1"), F.col("b")[0]["d"].alias("d1"), F.get("b", F.lit(1))["t"].alias("t2"), F.get("b", F.lit(1))["d"].alias("d2"))
    return out if pair else out.drop("pair")


def ratio_matches(nearest: DataFrame, ratio: float) -> DataFrame:
    """Lowe's filter: keeps a query whose nearest is clearly nearer than the second; zero second distances and queries
    with one candidate are dropped."""
    return nearest.filter((F.col("d2") > 0) & (F.col("d1") < ratio * F.col("d2")))


def mutual(forward: DataFrame, backward: DataFrame, a: str, b: str) -> DataFrame:
    """Cross-check: (a, b) that both directions name."""
    return forward.join(backward.select(a, b), [a, b], "left_semi")


#: Vectors that an index is fitted on, and queries among them that its probes are chosen by.
SAMPLE, TRIED = 20_000, 1_000


def _fit_cells(v: np.ndarray, recall: float, seed: int) -> tuple[np.ndarray, int]:
    """Centres of cells (k-means on the sample) and how many of the nearest cells to probe.

    The probes are the fewest with which the sample's own nearest vectors are met at the wanted rate and a margin; in the whole table
    nearest vectors are nearer, so the rate there is higher.
    """
    rng = np.random.default_rng(seed)
    k = max(1, min(1024, int(1.5 * math.sqrt(len(v)))))
    c = v[rng.choice(len(v), k, replace=False)]
    far = lambda x, y: (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
    for _ in range(8):
        cell = far(v, c).argmin(1)
        n = np.bincount(cell, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, cell, v)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
    cell = far(v, c).argmin(1)
    q = rng.choice(len(v), min(TRIED, len(v)), replace=False)
    d = far(v[q], v)
    d[np.arange(len(q)), q] = np.inf
    rank = (far(v[q], c).argsort(1).argsort(1))[np.arange(len(q)), cell[d.argmin(1)]]
    return c, int(np.quantile(rank, min(1.0, recall + 0.05), method="higher")) + 1


def cell_nearest(df: DataFrame, queries: DataFrame, qid: str, tid: str, vector: str, recall: float = 0.9, seed: int = 3) -> DataFrame:
    """``qid, nearest, distance``: approximate nearest other target of each query, by cells around centres.

    Centres are fitted on ``SAMPLE`` vectors at most (those of smallest hash); every target is indexed by its nearest centre.
    A query is compared with all targets of its nearest cells, as matrices in blocks (:func:`knn2`), so a hot cell is split
    and duplicates meet once. A query whose cells hold no other target is searched exactly; it has no row only if there is no
    other target. Null vectors take no part. How much of the table the probed cells hold depends on the data: little where
    vectors form groups, a third and more where they are spread evenly over many dimensions.
    """
    t = df.filter(F.col(vector).isNotNull()).select(F.col(tid).alias("t"), F.col(vector).alias("v")).dropDuplicates(["t"])
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(qid).alias("q"), F.col(vector).alias("v")).dropDuplicates(["q"])
    sample = [r[0] for r in t.orderBy(F.xxhash64("v"), "t").limit(SAMPLE).select("v").collect()]  # bounded
    if not sample:
        return q.select(F.col("q").alias(qid), F.lit(None).cast(t.schema["t"].dataType).alias("nearest"), F.lit(0.0).alias("distance")).limit(0)
    centres, probes = _fit_cells(np.array(sample, dtype=np.float64), recall, seed)

    def cells(n: int):
        def near(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_list()).astype(np.float64)
            d = (centres * centres).sum(1)[None] - 2 * x @ centres.T
            return pd.Series(list(d.argsort(1, kind="stable")[:, :n].astype(np.int32)))

        return F.pandas_udf(near, "array<int>")

    s = Scratch(df.sparkSession)
    tc = s.write(t.select("t", "v", cells(1)("v")[0].alias("cell")))
    qc = s.write(q.select("q", "v", F.explode(cells(probes)("v")).alias("cell")))
    two = knn2(qc.df, tc.df, "q", "t", "v", pair="cell")
    # a query that is a target itself has itself among its two nearest, or is as near to both of them
    other = lambda d, i, a, b: d.select(F.col(i).alias("q"), *[F.when(F.col("t1") == F.col(i), F.col(f"{x}2")).otherwise(F.col(f"{x}1")).alias(n) for x, n in (("t", "t"), ("d", "d"))]).filter("t IS NOT NULL")
    best = s.write(other(two, "q", "t", "d").groupBy("q").agg(F.min_by("t", F.struct("d", "t")).alias("t"), F.min("d").alias("d")))
    alone = q.join(best.df.select("q"), "q", "left_anti")
    exact = other(knn2(alone, t, "q", "t", "v"), "q", "t", "d")
    return s.settle(best.df.unionByName(exact).select(F.col("q").alias(qid), F.col("t").alias("nearest"), F.col("d").alias("distance")), tc, qc, best)


#: Candidates of a pair that one task folds in order, about a million a second; larger pairs are matched in rounds.
FOLD = 5_000_000


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags each row of sorted pairs: ``kept``, or which ends were taken before it."""
    now, taken_l, taken_r, seen = None, set(), set(), set()
    for b in batches:
        why = []
        for p, left, right in zip(*(b.column(c).to_pylist() for c in ("p", "l", "r"))):
            if p != now:
                now, taken_l, taken_r, seen = p, set(), set(), set()
            if (left, right) in seen:
                why.append("duplicate")
            elif left in taken_l or right in taken_r:
                why.append("conflict")
            else:
                why.append("kept")
                taken_l.add(left)
                taken_r.add(right)
                seen.add((left, right))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(why, pa.string())], names=["row", "why"])


def greedy_one_to_one(df: DataFrame, pair: str, left: str, right: str, order: Sequence[Column], fold: int = FOLD) -> DataFrame:
    """Greedy matching of each pair's candidates in ``order``, which must be total within a pair.

    Adds ``why``: ``kept`` if neither end was taken before, ``duplicate`` for a repetition of a kept (left, right),
    ``conflict`` for others with a taken end. Each pair is sorted (which spills) and folded in order by one task, which holds
    the taken ends of one pair. Pairs of more than ``fold`` candidates are matched in rounds instead: a candidate that is
    first among the open ones at both of its ends is certain to be kept, and its rivals are dropped; rounds are as many
    as the longest run of candidates that wait for one another.

    Rows with a null pair or end take no part; an empty table gives an empty result.
    """
    from skerry.plans.prefix import running_totals

    s = Scratch(df.sparkSession)
    t = s.write(df.dropna(subset=[pair, left, right]).withColumn("_row", F.monotonically_increasing_id()))
    os = [c.alias(f"o{i}") for i, c in enumerate(order)]
    slim = t.df.select(F.col("_row").alias("row"), F.col(pair).alias("p"), F.col(left).alias("l"), F.col(right).alias("r"), *os)
    hot = hot_keys(t.df.select(F.col(pair).alias("p")), ["p"], t.rows, floor=fold)
    small = slim.join(hot.df.select("p"), "p", "left_anti") if hot else slim
    by = [f"o{i}" for i in range(len(order))]
    why = small.repartition("p").sortWithinPartitions("p", *by).select("row", "p", "l", "r").mapInArrow(_fold, "row bigint, why string")
    if hot:
        named = slim.join(hot.df.select("p"), "p", "left_semi").withColumn("one", F.lit(1))
        keyed, _ = running_totals(named, ["p"], by, "one", "at", s)
        every = s.write(keyed.select("row", "p", "l", "r", "at"))
        live, kept = every, []
        while live.rows:
            firsts = [live.df.groupBy("p", e).agg(F.min("at").alias(f"m{e}")) for e in "lr"]
            j = live.df.join(firsts[0], ["p", "l"]).join(firsts[1], ["p", "r"])
            sure = s.write(j.filter("at = ml AND at = mr").select("row", "p", "l", "r"))
            kept.append(sure.df)
            rest = live.df.join(sure.df.select("p", "l"), ["p", "l"], "left_anti").join(sure.df.select("p", "r"), ["p", "r"], "left_anti")
            nxt = s.write(rest.select("row", "p", "l", "r", "at"))
            if live is not every:
                s.drop(live)
            live = nxt
        won = kept[0]
        for k in kept[1:]:
            won = won.unionByName(k)
        won = s.write(won)
        flags = every.df.join(won.df.select("row", F.lit(True).alias("k")), "row", "left").join(won.df.select("p", "l", "r", F.lit(True).alias("same")), ["p", "l", "r"], "left")
        why = why.unionByName(flags.select("row", F.when(F.col("k"), "kept").when(F.col("same"), "duplicate").otherwise("conflict").alias("why")))
    out = t.df.join(why, t.df["_row"] == why["row"]).drop("_row", "row")
    return s.settle(out, t)


def quantize(df: DataFrame, x: str, y: str, grid: float) -> DataFrame:
    """Adds lattice cell ``cx, cy``, rounded half to even."""
    return df.withColumn("cx", F.rint(F.col(x) / grid).cast("bigint")).withColumn("cy", F.rint(F.col(y) / grid).cast("bigint"))
