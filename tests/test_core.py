import math
import random
import statistics
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import geometry as g
from skerry.functions.text import tidy
from skerry.operators import aggregates as A
from skerry.operators import constraints as K
from skerry.operators import geometry as GM
from skerry.operators import graph as G
from skerry.operators import grid as R
from skerry.operators import matching as M
from skerry.operators import selection as S
from skerry.plans.engine import Engine, Operator, Param, TypeSpec
from skerry.plans.prefix import dense_ids, running_totals
from skerry.plans.skew import hot_keys, latest, salted, skew_join
from skerry.runtime import Scratch
from skerry.sources import files
from skerry.streaming.events import windowed_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_running_totals_cross_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [(k, i, i % 7) for k, n in (("hot", 500), ("b", 3), (None, 4)) for i in range(n)]
        got, _ = running_totals(spark.createDataFrame(data, "k string, i int, v int").repartition(5), ["k"], ["i"], "v", "before", Scratch(spark))
        for k, i, v, before in got.collect():
            assert before == sum(x % 7 for x in range(i))
        assert got.count() == len(data)
        ids, _ = dense_ids(spark.range(100).select((F.col("id") * 3).alias("a")), "n", Scratch(spark))
        assert rows(ids) == sorted([(3 * i, i) for i in range(100)], key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["'d' || id", "id * 2"])
def test_skew_join_equals_join(spark, name):
    """Dims with a text are split by salt, narrow ones broadcast; both equal the plain join, with repeated rows."""
    data = [(0, 7)] * 100 + [(0, i) for i in range(300)] + [(i % 20 + 1, i) for i in range(100)] + [(None, 1)]
    t = Scratch(spark).write(spark.createDataFrame(data, "k int, v int").repartition(3))
    dims = spark.range(0, 30, 2).selectExpr("int(id) AS k", f"{name} AS name")
    hot = hot_keys(t.df, ["k"], t.rows, floor=50, share=50)
    assert [c[0] for c in hot.counts] == [0]
    for how in ("inner", "left"):
        assert rows(skew_join(t.df, dims, ["k"], how, hot)) == rows(t.df.join(dims, "k", how))
    assert salted(t.df, ["k"], hot).groupBy("_salt").count().count() > 5


def test_hot_keys_by_sample(spark):
    """Of a table with many keys at the limit each is found, and few others."""
    n = spark.range(2_000_000).select(F.when(F.col("id") < 1_600_000, F.col("id") % 40).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(n, ["k"], 2_000_000, floor=20_000)
    assert sorted(k for k, _ in hot.counts) == list(range(40)) and all(32_000 < c < 48_000 for _, c in hot.counts)


def test_latest(spark):
    d = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, None, "c"), (2, None, "x"), (None, 1, "y")], "k int, t int, v string")
    assert rows(latest(d, ["k"], "t", ["v"])) == [(1, "b"), (2, "x")]


def test_tidy(spark):
    d = spark.createDataFrame([("\t Ab c  ",), (None,), ("",)], "s string")
    assert [r[0] for r in d.select(tidy("s")).collect()] == ["ab c", None, ""]


def test_percentiles_skip_gaps(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("a", None), ("a", math.nan), ("b", None)], "k string, v double")
    assert rows(A.exact_percentiles(d, ["k"], "v", {"p95": 0.95, "m": 0.5})) == [("a", pytest.approx(8.95), 2.5)]
    assert rows(A.mid_rank_percentile(spark.createDataFrame([("x", i, 1.0 if i > 7 else 0.0) for i in range(16)], "k string, i int, v double"), ["k"], "i", "v"))[-1][3] == 75.0
    assert A.exact_percentiles(d.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("floor", [10**9, 60])
def test_order_statistics_of_hot_groups(spark, monkeypatch, floor):
    """Sorted and bisected groups give the same exact numbers, with ties, far values and weights."""
    monkeypatch.setattr(A, "LEFT", 5)
    monkeypatch.setattr(A, "PARTS", 8)
    rnd = random.Random(floor)
    pick = lambda: rnd.choice([0.0, 1.0, 1.0, 2.5, rnd.gauss(0, 1), 1e300, -1e300, 10 ** rnd.randrange(9)])
    data = [("hot" if i % 3 else rnd.choice(["x", "y", None]), i, rnd.choice([None, math.nan, *[float(pick())] * 8]), rnd.randrange(4)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, i int, v double, w int")
    groups = {g: [(v, w, i) for k, i, v, w in data if k == g and v is not None and not math.isnan(v)] for g in ("hot", "x", "y")}
    want = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.g: r for r in A.exact_percentiles(df, ["g"], "v", want, hot_floor=floor).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert list(got[g])[1:] == pytest.approx(list(np.percentile([v for v, _, _ in vs], [100 * p for p in want.values()])), rel=1e-9)
    med = {r.g: r.m for r in A.weighted_median(df, ["g"], "v", "w", "m", hot_floor=floor).collect()}
    pct = {r.i: r.pct for r in A.mid_rank_percentile(df, ["g"], "i", "v", hot_floor=floor).collect()}
    assert len(pct) == 500
    for g, vs in groups.items():
        run, half = 0, sum(w for _, w, _ in vs) / 2
        for v, w, _ in sorted(vs):
            run += w
            if w and run >= half:
                assert med[g] == v
                break
        for v, _, i in vs:
            assert pct[i] == pytest.approx(100 * (sum(x < v for x, _, _ in vs) + sum(x == v for x, _, _ in vs) / 2) / len(vs))
    assert all(pct[i] is None for g, i, v, _ in data if g is None or v is None or math.isnan(v))


def test_ewma(spark):
    d = spark.createDataFrame([(k, i, float((i * 7 + k) % 11)) for k in range(5) for i in range(20)], "k int, i int, v double")
    got = {r.k: (r.estimate, r.n) for r in A.asymmetric_ewma(d, "k", ["i"], "v").collect()}
    for k in range(5):
        vs = [float((i * 7 + k) % 11) for i in range(20)]
        e = vs[0]
        for v in vs[1:]:
            e += (0.6 if v > e else 0.2) * (v - e)
        assert got[k] == (pytest.approx(e), 20)


def test_coverage_and_zero_fill(spark):
    pts = spark.createDataFrame([("f", 5.0 + 10 * (i % 8), 5.0 + 10 * (i // 8)) for i in range(64)] + [("g", 80.0, 80.0)], "k string, x double, y double")
    dom = spark.createDataFrame([("f",), ("g",), ("h",)], "k string")
    got = A.coverage(pts, ["k"], F.col("x"), F.col("y"), F.lit(80.0), F.lit(80.0), dom)
    assert rows(got) == [("f", 1.0), ("g", 1 / 64), ("h", 0.0)]


def test_top_k_cuts_hot_groups(spark):
    rnd = random.Random(1)
    data = [("hot" if i % 2 else f"g{i % 30}", i, rnd.randrange(50)) for i in range(600)]
    got = S.top_k(spark.createDataFrame(data, "g string, i int, s int"), ["g"], [F.desc("s"), F.asc("i")], 5)
    want = [x for k in {d[0] for d in data} for x in sorted([d for d in data if d[0] == k], key=lambda d: (-d[2], d[1]))[:5]]
    assert rows(got) == sorted(want, key=repr)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_even_positions(spark):
    d = spark.createDataFrame([("a", i) for i in range(11)] + [("b", i) for i in range(3)], "k string, i int")
    assert rows(S.even_sample(d, ["k"], ["i"], 4)) == [("a", 0), ("a", 10), ("a", 3), ("a", 6), ("b", 0), ("b", 1), ("b", 2)]


def test_spread_keypoints(spark):
    pts = spark.createDataFrame([(0, i, float(100 - i), float(i % 10), float(i // 10)) for i in range(100)], "im int, i int, s double, x double, y double")
    got = S.spread_keypoints(pts, "im", "i", "s", "x", "y", 20, 50.0)
    assert 20 <= got.count() <= 40 and 0 in {r.i for r in got.collect()}


LINKS = [("s", 0, 0, 1, 10), ("s", 1, 10, 2, 20), ("s", 2, 20, 0, 1), ("s", 0, 2, 1, 11), ("s", 1, 11, 2, 22)]


def test_tracks(spark):
    l = spark.createDataFrame(LINKS, "scope string, image_i int, feature_i int, image_j int, feature_j int")
    drop = G.build_tracks(l, "drop", 3)
    assert drop.select("track_id").distinct().count() == 1 and {r.image for r in drop.collect()} == {0, 1, 2}
    first = G.build_tracks(l, "first", 2)
    assert first.select("track_id").distinct().count() == 2 and first.groupBy("track_id", "image").count().filter("count > 1").isEmpty()
    assert G.build_tracks(l, "drop", 4).isEmpty()


def test_components_random(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(None, 5), (7, 7)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for most in (G.ONE_TASK, 10):  # in one task, and by rounds of contraction
        got = G.connected_components(spark.createDataFrame(edges, "src int, dst int"), one_task=most)
        assert {r[0]: r[1] for r in got.collect()} == {n: find(n) for n in root}
    assert G.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


SPLIT = [
    # no two tracks near each other; a pair that runs along together; three that do, one of them only through another
    ([(4, 2, 300, 7), (4, 5, 310, 9), (6, 2, 50, 700), (6, 5, 41, 690)], 0.0),
    ([(7, 1, 64, 5), (7, 3, 71, 8), (7, 6, 90, 2), (9, 3, 72.5, 6.5), (9, 6, 91.25, 0.5)], 0.5),
    ([(t, f, 40 * f + 1.5 * t, 12) for t in range(3) for f in range(4)], 2 / 3),
    # one frame in common is not enough, nor is the same frame twice; the tolerance itself is near enough
    ([(1, 0, 5, 5), (2, 0, 6, 6), (1, 1, 25, 5), (2, 1, 65, 6)], 0.0),
    ([(3, 8, 17, 17), (3, 8, 17.5, 17), (5, 8, 18, 18)], 0.0),
    ([(1, 0, 8, 8), (2, 0, 10, 6), (1, 1, 30, 30), (2, 1, 28, 32)], 0.5),
    ([(1, 0, 8, 8)], 0.0),
]


@pytest.mark.parametrize("obs,want", SPLIT)
def test_split_rate(spark, obs, want):
    d = spark.createDataFrame([(a, b, float(x), float(y)) for a, b, x, y in obs], "t int, f int, x double, y double")
    assert R.split_rate(d, "t", "f", "x", "y", 2.0).first().split_rate == pytest.approx(want)


@pytest.mark.parametrize("fold", [M.FOLD, 20])
def test_greedy_matches_sequential(spark, fold):
    rnd = random.Random(2)
    cand = [(p, i, rnd.randrange(12), rnd.randrange(12)) for p in range(4) for i in range(60)] + [(9, i, i // 2, (i + 1) // 2) for i in range(40)]
    odd = [(None, 1, 1, 1), (1, 99, None, 2)]
    df = spark.createDataFrame(cand + odd, "p int, i int, a int, b int").repartition(3)
    got = {(r.p, r.i): r.why for r in M.greedy_one_to_one(df, "p", "a", "b", [F.col("i")], fold=fold).collect()}
    want = {}
    for p in {c[0] for c in cand}:
        left, right, both = set(), set(), set()
        for q, i, a, b in cand:
            if q == p:
                want[p, i] = "duplicate" if (a, b) in both else "conflict" if a in left or b in right else "kept"
                if want[p, i] == "kept":
                    left.add(a), right.add(b), both.add((a, b))
    assert got == want and M.greedy_one_to_one(df.limit(0), "p", "a", "b", [F.col("i")]).count() == 0


def test_knn(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 8)), rng.normal(size=(50, 8))
    b[7] = b[3]
    f = lambda m, off: spark.createDataFrame([(i + off, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "i bigint, v array<double>")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    for r in M.knn2(f(a, 0), f(b, 100), "i", "i", "v").collect():
        o = np.lexsort((np.arange(50), d[r.i]))[:2]
        assert (r.t1, r.t2) == (o[0] + 100, o[1] + 100) and r.d1 == pytest.approx(d[r.i][o[0]])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_cell_nearest_recall(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    q = e.filter("vec_id % 20 = 0")
    near = {r.vec_id: r.nearest for r in M.cell_nearest(e, q, "vec_id", "vec_id", "embedding").collect()}
    ids, v = zip(*[(r.vec_id, r.embedding) for r in e.orderBy("vec_id").collect()])
    ids, v = np.array(ids), np.array(v)
    asked = np.flatnonzero(ids % 20 == 0)
    d = ((v[asked, None] - v[None]) ** 2).sum(2)
    d[np.arange(len(asked)), asked] = np.inf
    right = sum(near[ids[i]] == ids[j] for i, j in zip(asked, d.argmin(1)))
    assert len(near) == len(asked) and right >= 0.9 * len(asked)


def test_cell_nearest_edges(spark):
    v = np.random.default_rng(5).normal(size=(60, 8)) * 1000
    v[:30:3] = v[1] + np.arange(10)[:, None] * 1e-3
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (3, v[3].tolist())], "i bigint, v array<double>")
    got = {r.i: (r.nearest, r.distance) for r in M.cell_nearest(d, d, "i", "i", "v", recall=1.0).collect()}
    dist = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) + np.diag([np.inf] * 60)
    assert got.keys() == set(range(60)) and sum(got[i][1] == pytest.approx(dist[i].min()) for i in got) >= 57
    assert M.cell_nearest(d.filter("i = 0"), d.filter("i = 0"), "i", "i", "v").count() == 0 == M.cell_nearest(d.limit(0), d, "i", "i", "v").count()


def test_constraints(spark):
    d = spark.createDataFrame([(0, math.nan), (4, 2.0)], "id bigint, x double")
    assert K.structural_problems(d, [K.Field("id", "int"), K.Field("y", "float"), K.Field("x", "str"), K.Field("z", "int", True)]) == ["y: missing", "x: double, declared str"]
    assert K.extras(d, [K.Field("id", "int")]) == ["x"]
    got = K.problems(d, [K.Field("id", "int")], [K.NoNaN("x"), K.Within("x", 0, 1), K.MaxPlusOne("id", 5), K.NonEmpty()])
    assert got == ["NoNaN: x_nan = 1", "Within: x_outside = 1"]


def test_geometry(spark):
    ident = F.struct(*[F.lit(float(i == j)).alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[F.lit(0.0).alias(f"t{i}") for i in range(3)])
    yaw = F.struct(*[F.lit(x).alias(f"r{i // 3}{i % 3}") for i, x in enumerate([math.cos(0.1), 0.0, math.sin(0.1), 0.0, 1.0, 0.0, -math.sin(0.1), 0.0, math.cos(0.1)])], *[F.lit(0.0).alias(f"t{i}") for i in range(3)])
    k = F.struct(F.lit(400.0).alias("fx"), F.lit(400.0).alias("fy"), F.lit(400.0).alias("cx"), F.lit(300.0).alias("cy"))
    d = spark.range(1).select(ident.alias("a"), yaw.alias("b"), k.alias("k"))
    back = g.unproject(F.col("b"), F.col("k"), F.lit(410.0), F.lit(280.0), F.lit(3.0))
    u, v, z = g.project(F.col("b"), F.col("k"), back)
    dist = F.struct(*[x.alias(n) for x, n in zip(g.distort(F.lit(0.2), F.lit(-0.1), *[F.lit(c) for c in (0.1, 0.01, 0.001, 0.002, 0.0)]), "xy")])
    und = g.undistort(F.col("q.x"), F.col("q.y"), *[F.lit(c) for c in (0.1, 0.01, 0.001, 0.002, 0.0)])
    r = d.withColumn("q", dist).select(u.alias("u"), v.alias("v"), z.alias("z"), g.rotation_angle_deg(F.col("a"), F.col("b")).alias("ang"), und.alias("p")).first()
    assert (r.u, r.v, r.z) == pytest.approx((410, 280, 3)) and r.ang == pytest.approx(math.degrees(0.1)) and (r.p.x, r.p.y) == pytest.approx((0.2, -0.1), abs=1e-7)


def test_similarity(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(20, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    b = 2.5 * a @ q.T + [1, 2, 3]
    r = GM.similarity(spark.createDataFrame([(*map(float, x), *map(float, y)) for x, y in zip(a, b)], "ax double, ay double, az double, bx double, by double, bz double")).first()
    assert r.scale == pytest.approx(2.5) and (r.t0, r.t1, r.t2) == pytest.approx((1, 2, 3)) and r.r01 == pytest.approx(q[0, 1])


def test_files(spark, tmp_path):
    (tmp_path / "d.bin").write_bytes(b"3&2&1&" + np.arange(6, dtype="<f4").tobytes())
    d = files.depth_maps(spark, str(tmp_path / "d.bin"))
    assert rows(d.select("px", "py", "depth")) == [(x, y, float(3 * y + x)) for x in range(3) for y in range(2)]
    pts = spark.createDataFrame([(1.0, 2.0, 3.0, 9, 8, 7), (math.nan, 0.0, 0.0, 0, 0, 0)], "x double, y double, z double, r int, g int, b int")
    assert files.write_ply(pts, str(tmp_path / "c.ply"), ["made"]) == 1
    h = files.ply_headers(spark, str(tmp_path / "c.ply")).first()
    assert (h.format, h.vertices, h.properties) == ("binary_little_endian", 1, ["x", "y", "z", "red", "green", "blue"])
    (tmp_path / "images.txt").write_text("# head\n1 1 0 0 0 0.5 -1 2e-1 1 a.png\n10.5 20.1 -1 3 4 5\n")
    assert rows(files.pose_text(spark, str(tmp_path / "images.txt"))) == [(1, 1.0, 0.0, 0.0, 0.0, 0.5, -1.0, 0.2, 1, "a.png")]
    (tmp_path / "t.md").write_text("# One\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\ntext\n")
    assert [(r.section, r.cells) for r in files.markdown_tables(spark, str(tmp_path / "t.md")).orderBy("line").collect()] == [("One", ["a", "b"]), ("One", ["1", "2"])]
    assert files.json_results(spark, str(tmp_path / "none*.json"), "a int").count() == 0
    (tmp_path / "x.png").write_bytes(b"1234")
    assert rows(files.images(spark, str(tmp_path)).select("name", "length")) == [("x.png", 4)]


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.add_type(TypeSpec("scene/v1", {"images": [K.Field("image_idx", "int")]}, {"images": [K.NonEmpty()]}))
    e.add_type(TypeSpec("points/v1", {"points": [K.Field("x", "float")]}, {"points": [K.NoNaN("x")]}))
    calls = []

    def scene(ins, p):
        calls.append("scene")
        return {"scene": {"images": spark.range(p["n"]).select(F.col("id").cast("int").alias("image_idx"))}}

    def points(ins, p):
        calls.append("points")
        x = F.lit(math.nan) if p["bad"] else F.col("image_idx") * p["scale"]
        return {"points": {"points": ins["scene"]["images"].select(x.cast("double").alias("x"))}}

    e.register(Operator("Scene", "1", {}, {"scene": "scene/v1"}, scene, {"n": Param("integer", 3, 1, 100)}))
    e.register(Operator("Points", "1", {"scene": "scene/v1"}, {"points": "points/v1"}, points, {"scale": Param("number", 2.0), "bad": Param("boolean", False)}))
    with pytest.raises(ValueError):
        e.register(Operator("Scene", "1", {}, {}, scene))
    s = e.run("Scene", "r", {})["scene"]
    p = e.run("Points", "r", {"scene": s})["points"]
    assert e.run("Points", "r", {"scene": s}, {"scale": 2})["points"] == p and calls == ["scene", "points"]
    assert e.check("Points", {"scene": p, "odd": s}, {"scale": "x", "what": 1})["problems"] == ["what: unknown parameter", "scale: a number is wanted, not 'x'", "odd: unknown slot", "scene: is a points/v1, a scene/v1 is wanted"]
    with pytest.raises(ValueError):
        e.run("Points", "r", {"scene": s}, {"bad": True})
    assert [r.status for r in e.steps("r").collect()] == ["ok", "ok", "cached", "failed"]
    moved = e.replay("r", s, {"n": 5})
    new = moved[p]
    assert e.load(new, "points").count() == 5 and e.load(p, "points").count() == 3
    assert [tuple(r)[:3] for r in e.compare([p, new]).collect()] == [("points_rows", 3.0, 5.0)]
    assert {r.module for r in e.lineage(new).collect()} == {"Scene", "Points"} and e.diverge(p, new).count() == 2
    assert e.leaves("r") == [p, p, new, new]
    assert [r.name for r in e.find(consumes="scene/v1").collect()] == ["Points"] and [r.name for r in e.successors("Scene").collect()] == ["Points"]
    assert [r.type for r in e.orphans().collect()] == ["points/v1"]


def test_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    q = windowed_counts(spark.readStream.schema(src.schema).parquet("/root/testdata/sf0.001/events.parquet*"), "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == src.count()


def test_core_does_not_name_llm():
    core = Path(__file__).parent.parent / "skerry"
    assert not [p for p in core.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
