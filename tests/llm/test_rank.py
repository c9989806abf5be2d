import math
import random
from statistics import NormalDist

import pytest

from skerry.llm.rankfuse import Score, fused_scores
from skerry.llm.topn import Order, top_n

ORDER = [Order("s", gaps="out"), Order("p"), Order("q", largest=False)]


def items(n, seed):
    rnd = random.Random(seed)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, 1e308, -1e308]
    out = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.4 else rnd.choice([None, *[f"g{k}" for k in range(12)]])
        s = rnd.choice(odd) if rnd.random() < 0.2 else rnd.choice([1.0, 0.5, rnd.random()])
        p = rnd.choice([None, 0, 1, 2**62, -(2**62), rnd.randrange(5)])
        out.append((g, i, s, p, rnd.choice([None, math.nan, 0.25, rnd.random()]), 7))
    return out + out[:40] + [("g1", None, 1.0, 1, 1.0, 7)]


def best(rows, n):
    def key(r):
        gap = r[4] is None or math.isnan(r[4])
        return (-r[2], (r[3] is None, -(r[3] or 0)), (gap, 0 if gap else r[4]), r[1])

    out = set()
    for g in {r[0] for r in rows if r[0] is not None}:
        own = sorted({r for r in rows if r[0] == g and r[1] is not None and r[2] is not None and not math.isnan(r[2])}, key=key)
        out |= {(g, k + 1, r[1]) for k, r in enumerate(own[:n])}
    return out


@pytest.mark.parametrize("n,floor", [(3, 200_000), (7, 30)])
def test_top_n(spark, n, floor):
    rows = items(700, n)
    # columns named like those the operator makes
    df = spark.createDataFrame(rows, "g string, item bigint, s double, p bigint, q double, k0 int").repartition(5)
    got = {tuple(r) for r in top_n(df, "g", ORDER, "item", n, hot_floor=floor).collect()}
    assert got == best(rows, n)


def test_top_n_edges(spark):
    df = spark.createDataFrame([], "g string, item bigint, s double, p bigint, q double")
    assert top_n(df, "g", ORDER, "item", 3).count() == 0
    one = spark.createDataFrame([("a", 1, 1.0, 1, 1.0)] * 5, df.schema)
    assert [tuple(r) for r in top_n(one, "g", ORDER, "item", 3).collect()] == [("a", 1, 1)]
    assert top_n(one, "g", ORDER, "item", 0).count() == 0


SCORES = [Score("a"), Score("b", False, 2.0), Score("c")]


def brute(rows):
    inv, out = NormalDist().inv_cdf, {}
    for g in {r[0] for r in rows if r[0] is not None}:
        own = {r for r in rows if r[0] == g and r[1] is not None}
        val = {r[1]: tuple(-math.inf if v is None or math.isnan(v) else x.more_is_better * v - (not x.more_is_better) * v for x, v in zip(SCORES, r[2:5])) for r in own}
        for i in val:
            z = 0.0
            for k, x in enumerate(SCORES):
                vs = [v[k] for v in val.values()]
                pct = (sum(v < val[i][k] for v in vs) + sum(v == val[i][k] for v in vs) / 2) / len(vs)
                z += inv(pct) * x.weight / 4
            out[g, i] = z
    return out


@pytest.mark.parametrize("floor", [200_000, 60])
def test_fused_scores(spark, floor):
    rnd = random.Random(3)
    pick = lambda: rnd.choice([None, math.nan, 0.0, -0.0, 1.0, rnd.gauss(0, 100)])
    rows = [("hot" if i % 3 else rnd.choice(["x", "y", None]), i, pick(), pick(), pick(), "clash") for i in range(300)]
    df = spark.createDataFrame(rows + rows[:30], "grp string, id int, a double, b double, c double, item string")
    got = {(r.grp, r.id): r.fused for r in fused_scores(df, ["grp"], "id", SCORES, hot_floor=floor).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    assert fused_scores(df.limit(0), ["grp"], "id", SCORES).count() == 0
