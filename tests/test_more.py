import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import graph as G
from skerry.operators import health as H
from skerry.operators import lineage as L
from skerry.operators import matching as M
from skerry.operators import records as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def poses(spark, rot, centre, scope="s"):
    data = [(scope, i, {**{f"r{j}{k}": float(r[j, k]) for j in range(3) for k in range(3)}, **{f"t{j}": float((-r @ c)[j]) for j in range(3)}}, True) for i, (r, c) in enumerate(zip(rot, centre))]
    names = [f"r{j}{k}" for j in range(3) for k in range(3)] + ["t0", "t1", "t2"]
    return spark.createDataFrame(data, "scope string, image_idx int, pose struct<" + ",".join(f"{n}:double" for n in names) + ">, valid boolean")


def test_estimators(spark):
    rng = np.random.default_rng(3)
    rot = [np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in range(8)]
    rot = [r * np.sign(np.linalg.det(r)) for r in rot]
    c = rng.normal(size=(8, 3))
    q = rot[0]
    a, b = poses(spark, rot, c), poses(spark, rot, 2.5 * c @ q.T + [1, 2, 3])
    assert H.centre_agreement(a, b).first().median_of_span == pytest.approx(0, abs=1e-9)
    off = c + rng.normal(size=c.shape) * 0.3
    x, y = off - off.mean(0), c - c.mean(0)
    u, s, vt = np.linalg.svd(y.T @ x / 8)
    d = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    res = np.linalg.norm((s * np.diag(d)).sum() / (x**2).sum(1).mean() * x @ (u @ d @ vt).T - y, axis=1)
    got = H.centre_agreement(poses(spark, rot, off), poses(spark, rot, c)).first().median_of_span
    assert got == pytest.approx(np.median(res) / np.linalg.norm(np.ptp(c, axis=0)))
    assert H.centre_agreement(a.filter("image_idx < 5"), b).count() == 0
    t = {r.form: r for r in H.two_estimators(poses(spark, rot, off), a, poses(spark, rot, c + rng.normal(size=c.shape) * 0.01)).collect()}
    assert t["centre"].fires and t["centre"].versus_one > 0 and t["rotation"].ratio is None and t["rotation"].fires is None


def test_errors_and_windows(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0)] * 30 + [("a", 2.0, 1e9), ("b", 1.0, math.nan), ("c", 1e-9, 5.0), ("c", None, 4.0)], "s string, x double, y double")
    r = {x.s: x for x in H.error_readings(d, ["s"], "x", "y", F.lit(100.0)).collect()}
    assert (r["a"].escaped, r["a"].diverged, r["a"].mean_after) == (1, False, 1.0) and r["b"].diverged and r["b"].mean_after is None and r["c"].diverged
    assert H.window_rungs(10, 100) == [(28, "default"), (40, "last_resort")] and H.window_rungs(28, 30) == [(30, "last_resort")] and H.window_rungs(9, 9) == []


def test_components_and_cover(spark):
    pts = spark.createDataFrame([("m", i, float(i)) for i in range(4)], "s string, point_idx int, error double")
    obs = spark.createDataFrame([("m", f, p) for f, p in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 1), (0, 2), (1, 2), (2, 2), (3, 2))], "s string, frame_idx int, point_idx int")
    cam = spark.createDataFrame([("m", i, i < 3) for i in range(4)] + [("empty", 0, False)], "s string, image_idx int, valid boolean")
    focal = spark.createDataFrame([("m", 500.0)], "s string, focal double")
    r = {x.s: x for x in H.components(pts, obs, cam, ["s"], focal).collect()}
    assert (r["m"].registration, r["m"].composition, r["m"].error_px, r["m"].error, r["m"].point_count) == (0.75, pytest.approx(2 / 3), 1.5, 3.0, 4)
    assert r["empty"].registration == 0 and r["empty"].error is None and r["empty"].point_count == 0
    reg = cam.filter("valid").select("s", F.col("image_idx").alias("frame_idx"))
    assert rows(H.still_covered(obs, reg, ["s"], "frame_idx", "point_idx")) == [("m", 0, pytest.approx(2 / 3)), ("m", 1, pytest.approx(2 / 3)), ("m", 2, 1.0), ("m", 3, 1.0)]
    lost = H.lost_and_gained(spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(2,), (3,), (None,)], "i int"), ["i"])
    assert rows(lost) == [(1, "lost"), (3, "gained")]


def test_series_and_cloud(spark):
    d = spark.createDataFrame([("long", i, float((i * 7) % 300)) for i in range(300)] + [("short", i, 1.23456789) for i in range(3)] + [("short", 9, math.nan)], "k string, i int, v double")
    r = {x.k: x for x in H.series_summary(d, ["k"], "i", "v").collect()}
    assert [e.v for e in r["long"].lowest] == list(map(float, range(8))) and r["long"].entries is None and r["long"].highest[0].v == 299.0
    assert [tuple(e) for e in r["short"].entries] == [(i, 1.23457) for i in range(3)] and r["short"].lowest is None and r["short"].n == 3
    c = spark.createDataFrame([("c", 0.0, 0.0, 0.0), ("c", 2.0, 0.0, 0.0), ("c", math.nan, 1.0, 1.0)], "k string, x double, y double, z double")
    s = H.cloud_summary(c, ["k"], "x", "y", "z", {"p50": 0.5}).first()
    assert (s.points, s.min_x, s.max_x, s.mean_x, s.p50) == (2, 0.0, 2.0, 1.0, 1.0)


def test_paired_errors(spark):
    a = spark.createDataFrame([(1, 0, 0, 3.0), (2, 1, 1, 4.0), (-1, 2, 2, 9.0)], "track_id int, row int, point_idx int, error double")
    b = spark.createDataFrame([(1, 0, 0, 9.0), (1, 5, 0, 1.0), (2, 1, 1, math.nan)], "track_id int, row int, point_idx int, error double")
    got = H.paired_error_by_support(a, b, spark.createDataFrame([(0, 7), (1, 2)], "point_idx int, len int"))
    assert rows(got) == [(2, 0, None), (3, 0, None), (4, 0, None), (5, 1, 2.0)]


def test_closure_random(spark):
    rnd = random.Random(5)
    e = {(i, rnd.randrange(i)) for i in range(1, 40) for _ in range(2)} | {(100, 101), (101, 100), (7, 7)}
    got = {(r.child, r.ancestor): r.depth for r in G.closure(spark.createDataFrame(list(e) + [(None, 1)], "a int, b int"), "a", "b").collect()}
    want = {}
    for s in {a for a, _ in e}:
        front, depth, seen = {s}, 0, {s}
        while front:
            depth += 1
            front = {b for a, b in e if a in front} - seen
            seen |= front
            want |= {(s, b): depth for b in front}
    assert got == want
    assert G.closure(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_merge_logs(spark):
    s = "run string, i int, module string, replay_of int"
    theirs = spark.createDataFrame([("r", 0, "a", None), ("r", 1, "b", None)], s)
    ours = spark.createDataFrame([("r", 1, "c", None), ("r", 2, "d", 1), ("q", 0, "e", None)], s)
    assert rows(L.merge_logs(theirs, ours, "run", "i", "replay_of")) == [("q", 0, "e", None), ("r", 0, "a", None), ("r", 1, "b", None), ("r", 2, "d", 3), ("r", 3, "c", None)]


def test_lookups(spark):
    k = spark.createDataFrame([("x/a",), ("x/b",), ("y/b",)], "key string")
    t = spark.createDataFrame([("a",), ("b",), ("X/b",), ("short",), ("z/a",), ("",), (None,)], "token string")
    got = {r.token: r.key for r in R.canonical(t, "token", k, "key", {"short": "y/b"}, {"x": "x", "y": "y"}).collect()}
    assert got == {"a": "x/a", "b": None, "X/b": "x/b", "short": "y/b", "z/a": None, "": None, None: None}
    p = spark.createDataFrame([("/data/scan1/img",), ("/data/scan11/",), (None,), ("",)], "path string")
    e = spark.createDataFrame([("scan1",), ("/data/scan1/",), ("scan",), (None,), ("",)], "entry string")
    assert {r.path: r.entry for r in R.under_entries(p, "path", e, "entry").collect()} == {"/data/scan1/img": "data/scan1", "/data/scan11/": None, None: None, "": None}
    n = spark.createDataFrame([("at 0.1333. and 12.5.3, .7 or 00",), (None,)], "t string").select(R.numbers_in(F.col("t")).alias("n"))
    assert [sorted(r.n) if r.n is not None else None for r in n.collect()] == [["0", "0.1333", "00", "12", "12.5"], None]


def test_small_rows(spark):
    d = spark.createDataFrame([({"Seed": 1.0, "k": 2.0}, "2024:05:01 12:30:00", 123456.789), (None, "no", math.nan), ({}, None, 0.0)], "m map<string,double>, t string, v double")
    r = R.scrubbed(d, ["m"], ["seed"]).select("m", R.exif_seconds(F.col("t")).alias("t"), R.significant(F.col("v"), 3).alias("v")).collect()
    assert [x.m for x in r] == [{"k": 2.0}, None, {}] and [x.t for x in r] == [1714566600, None, None] and r[0].v == 123000.0
    v = R.validated(d, {"dated": F.col("t").isNotNull(), "big": F.col("v") > 1}).select("problems")
    assert sorted(x[0] for x in v.collect()) == [[], [], ["dated", "big"]]
    images = spark.createDataFrame([("a", 4), ("b", 1), ("c", None)], "s string, n int")
    assert rows(M.band_pairs(images, "n", ["s"], 1)) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3)] and M.band_pairs(images, "n", ["s"]).count() == 6
    assert rows(M.stride_pairs(images, "n", 2, ["s"])) == [("a", 0, 2), ("a", 1, 3)]


def test_engine_questions(spark, tmp_path):
    from skerry.operators import constraints as K
    from skerry.plans.engine import Engine, Operator, Param, TypeSpec

    e = Engine(spark, str(tmp_path))
    e.add_type(TypeSpec("n/v1", {"t": [K.Field("id", "int")]}))
    run = lambda ins, p: {"out": {"t": spark.range(p["n"])}}
    e.register(Operator("Make", "1", {}, {"out": "n/v1"}, run, {"n": Param("integer", 2, 1, 9, (1, 2, 3))}))
    e.register(Operator("Check", "1", {"a": "n/v1", "b": "n/v1"}, {"out": "n/v1"}, lambda ins, p: {"out": ins["a"]}, optional=frozenset({"b"})))
    x = e.run("Make", "r", {})["out"]
    assert e.wire("Check", {"n/v1": x}) == {"a": x} and e.wire("Check", {"n/v1": "y"}, {"a": x, "b": "z", "c": "q"}) == {"a": x, "b": "z"}
    y = e.run("Check", "r", {"a": x})["out"]
    z = e.run("Make", "r", {}, {"n": 3})["out"]
    assert e.leaves("r") == [y, z] and e.leaves("r", ["Check"]) == [x, y, z]
    s = e.summary("r", "Check")
    assert (s["steps"], s["ok"], s["failed"]) == (3, 3, 0) and s["verdicts"] == {x: "ok", y: "unverified", z: "unverified"}
    d = e.describe("Make")
    assert d["params"]["properties"]["n"] == {"type": "integer", "default": 2, "minimum": 1, "maximum": 9, "enum": [1, 2, 3]} and not d["transform"] and e.describe("Check")["transform"]
    with pytest.raises(ValueError):
        e.replay("r", x, {"n": 1}, toward=z)


@pytest.fixture
def no_broadcast(spark):
    """No table can be broadcast (a hash table takes 1 MB), as ones of some 100 MB can't on a small driver."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", 8 << 10)
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def _above(e, starts):
    want = {}
    up = {}
    for a, b in e:
        up.setdefault(a, set()).add(b)
    for s in starts:
        front, depth, seen = {s}, 0, {s}
        while front:
            depth += 1
            front = {b for a in front for b in up.get(a, ())} - seen
            seen |= front
            want |= {(s, b): depth for b in front}
    return want


def test_ancestry_without_broadcast(spark, no_broadcast):
    def check(e, starts, most=None):
        got = G.ancestry(spark.createDataFrame([*e, (None, 1), (1, None)], "a int, b int"), "a", "b", spark.createDataFrame([(x,) for x in [*starts, None, *starts]], "s int"), "s", most)
        assert got.schema.simpleString() == "struct<start:int,ancestor:int,depth:int>"
        got = [((r.start, r.ancestor), r.depth) for r in got.collect()]
        want = {k: d for k, d in _above(e, starts).items() if most is None or d <= most}
        assert len(got) == len(want) and dict(got) == want

    rnd = random.Random(11)
    tree = {(i, i // 2) for i in range(1, 1500)}
    deep = {(i, i - 1 - rnd.randrange(min(i, 3))) for i in range(1, 90)}  # 40 and more steps
    turns = {(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2002), (2004, 2003), (7000, 7000), (2005, 2005), (3, 3), (2010, 2011), (2011, 2010)}
    check(tree, range(1500))
    check({(i + 3000, p + 3000) for i, p in deep} | tree, range(4000))
    check({(i + 3000, p + 3000) for i, p in deep} | turns, [*range(3000, 3200, 2), *range(2000, 2012), 3001, 5])
    check({(i, i - 1) for i in range(1, 70)} | turns - {(3, 3)}, range(2100))
    check({(i, rnd.randrange(i)) for i in range(1, 400) for _ in range(2)} | turns, range(400))
    check(tree, [5, 999, 1498])
    check(tree, range(1500), 3)
    check({(2000, 2001), (2001, 2000)}, [2000, 2001])
    check(set(), [1, 2])


def test_ancestry_rounds_of_the_query(spark, no_broadcast):
    """The query's own rows, of 1,500 orders, on a driver that can't hold their table."""
    from skerry.queries import graphs

    got = {r.ancestor: (r.below, r.deepest) for r in graphs.QUERIES["ancestry"](spark, "/root/testdata/sf0.001").collect()}
    n = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    want = {}
    for (_, b), d in _above({(i, i // 2) for i in range(1, n)}, range(n)).items():
        k, top = want.get(b, (0, 0))
        want[b] = (k + 1, max(top, d))
    assert got == want


@pytest.fixture
def small_broadcast(spark):
    """A hash table of 1 MB, the least there is, can be broadcast; that of 20,000 points can't."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", 1100 << 10)
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def _same_as_sql(spark, name, d="/root/testdata/sf0.1"):
    duckdb = pytest.importorskip("duckdb")
    from skerry.queries import geometry

    db = duckdb.connect()
    for t in ("part", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = db.sql(geometry.SQL[name])
    assert rows(geometry.QUERIES[name](spark, d).select(*want.columns)) == sorted(want.fetchall(), key=repr)


def test_reprojection_without_broadcast(spark, small_broadcast):
    _same_as_sql(spark, "reprojection")


def test_triangulation_without_broadcast(spark, small_broadcast):
    _same_as_sql(spark, "triangulation")
