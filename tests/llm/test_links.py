import random

import pytest

from skerry.llm import components as C
from skerry.llm.components import consolidate
from skerry.llm.keypoints import keypoint_groups
from skerry.plans.skew import hot_keys


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("floor", [200_000, 20])
def test_consolidate(spark, monkeypatch, floor):
    monkeypatch.setattr(C, "hot_keys", lambda df, k, n: hot_keys(df, k, n, floor=floor, share=20))
    rnd = random.Random(5)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(0, 2000 + i) for i in range(120)] + [(5000, 2000 + i) for i in range(120)]
    pairs += [(7000 + i, 7001 + i) for i in range(70)] + [(None, 3), (9001, None), (9, 9), (-5, 1)]
    s = Sets()
    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                s.find(x)
        if a is not None and b is not None:
            s.join(a, b)
    s.find(8888)
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs + pairs[:50]], "src bigint, dst bigint, hi string")
    got = consolidate(df, records=spark.createDataFrame([(8888,), (None,)], "record bigint"))
    assert {r[0]: r[1] for r in got.collect()} == {x: s.find(x) for x in s.up}
    assert consolidate(df.limit(0)).count() == 0


def fixture(wide):
    rnd = random.Random(wide)
    big = 1 << 55 if wide else 1
    caps = ["A/one", " a/ONE", "b/two"]
    pairs = [(i, rnd.choice(caps), *rnd.sample(range(6), 2), 1) for i in range(30)]
    matches = [(rnd.randrange(34), rnd.choice([None, rnd.randrange(9) * big]), rnd.choice([None, rnd.randrange(9) * big])) for _ in range(120)]
    obs = [(rnd.choice([*caps, None]), rnd.choice([None, *range(9)]), rnd.randrange(7), rnd.choice([None, rnd.randrange(9) * big])) for _ in range(60)]
    return pairs, matches, obs


@pytest.mark.parametrize("wide,packed", [(0, True), (0, False), (1, True)])
def test_keypoints(spark, wide, packed):
    pairs, matches, obs = fixture(wide)
    s, of = Sets(), {p[0]: (p[1].strip().lower(), p[2], p[3]) for p in pairs}
    for pair, fi, fj in matches:
        if pair in of:
            cap, i, j = of[pair]
            ends = [(cap, im, f) for im, f in ((i, fi), (j, fj)) if f is not None]
            for e in ends:
                s.find(e)
            if len(ends) == 2:
                s.join(*ends)
    tracks = {}
    for cap, t, im, f in obs:
        if cap is not None and f is not None:
            k = (cap.strip().lower(), im, f)
            s.find(k)
            if t is not None:
                s.join(k, tracks.setdefault((k[0], t), k))
    p = spark.createDataFrame(pairs + pairs[:5], "pair_idx bigint, capture string, image_i int, image_j int, match_count int")
    m = spark.createDataFrame([(n, "zz", *x) for n, x in enumerate(matches)], "match_idx bigint, capture string, pair_idx bigint, feature_i bigint, feature_j bigint")
    o = spark.createDataFrame(obs + obs[:9], "capture string, track_id bigint, frame_idx int, feature_idx bigint")
    got = {tuple(r) for r in keypoint_groups(p, m, o, packed=packed).collect()}
    assert got == {(*k, *s.find(k)[1:]) for k in s.up}


def test_keypoints_empty(spark):
    p = spark.createDataFrame([], "pair_idx bigint, capture string, image_i int, image_j int")
    m = spark.createDataFrame([], "pair_idx bigint, feature_i bigint, feature_j bigint")
    o = spark.createDataFrame([], "capture string, track_id bigint, frame_idx int, feature_idx bigint")
    assert keypoint_groups(p, m, o).count() == 0
