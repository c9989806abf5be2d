"""Keypoints that show the same point: matches and built tracks as links of the component operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import tidy
from skerry.llm.components import star_components
from skerry.plans.prefix import dense_ids
from skerry.plans.skew import hot_keys, skew_join
from skerry.runtime import Scratch, Written

_POINT = ("cap", "image", "feature")


def _links(pairs: DataFrame, matches: DataFrame, observations: DataFrame, s: Scratch) -> tuple[Written, Written, Written]:
    """Numbered captures; links (cap, image, feature, image2, feature2); observations (cap, track, image, feature)."""
    p = s.write(pairs.select("pair_idx", tidy("capture").alias("capture"), "image_i", "image_j").dropna().groupBy("pair_idx").agg(F.min(F.struct("capture", "image_i", "image_j")).alias("v")).select("pair_idx", "v.*"))
    o = s.write(observations.filter("feature_idx IS NOT NULL AND frame_idx IS NOT NULL AND capture IS NOT NULL").select(tidy("capture").alias("capture"), "track_id", F.col("frame_idx").alias("image"), F.col("feature_idx").alias("feature")).distinct())
    caps, _ = dense_ids(p.df.select("capture").unionByName(o.df.select("capture")).distinct(), "cap", s)
    caps = s.write(caps)
    pc = skew_join(p.df, caps.df, ["capture"], "inner", hot_keys(p.df, ["capture"], p.rows)).drop("capture")
    pc = s.write(pc).df
    m = matches.select("pair_idx", "feature_i", "feature_j").filter("pair_idx IS NOT NULL AND coalesce(feature_i, feature_j) IS NOT NULL")
    rows = m.count()
    links = skew_join(m, pc, ["pair_idx"], "inner", hot_keys(m, ["pair_idx"], rows))
    links = s.write(links.select("cap", F.col("image_i").alias("image"), F.col("feature_i").alias("feature"), F.col("image_j").alias("image2"), F.col("feature_j").alias("feature2")))
    seen = s.write(skew_join(o.df, caps.df, ["capture"], "inner", hot_keys(o.df, ["capture"], o.rows)).select("cap", "track_id", "image", "feature"))
    s.drop(p, o)
    return caps, links, seen


def _bits(n: int | None) -> int:
    return max(1, int(n or 0).bit_length())


def keypoint_groups(pairs: DataFrame, matches: DataFrame, observations: DataFrame, packed: bool = True) -> DataFrame:
    """``capture, image_idx, feature_idx, group_image_idx, group_feature_idx`` of every keypoint that is named.

    A keypoint becomes one whole number that sorts by capture, image and feature: packed into 62 bits where capture number,
    image and feature fit (looked up from their maxima), else numbered densely over their range-sorted distinct values.
    A track is a record of its own above all keypoints, so a track of any length is one edge per observation and never the
    name of a group. Links never cross captures.

    Defined cases: captures agree without regard to case and outer white space, a null capture or image names nothing; a
    match whose pair is not on record names nothing; a null feature names nothing, the other end still counts; an
    observation without track is a keypoint of its own; repeated rows count once; of several rows of a pair_idx the
    smallest counts; empty tables give an empty result; extra columns are ignored.
    """
    s = Scratch(pairs.sparkSession)
    caps, links, seen = _links(pairs, matches, observations, s)
    a = links.df.agg(*[F.min(F.least(*c)) for c in (("image", "image2"), ("feature", "feature2"))], *[F.max(F.greatest(*c)) for c in (("image", "image2"), ("feature", "feature2"))]).first()
    b = seen.df.agg(F.min("image"), F.min("feature"), F.max("image"), F.max("feature"), F.min("track_id"), F.max("track_id")).first()
    low = min([0, *(x for x in (a[0], a[1], b[0], b[1], b[4]) if x is not None)])
    bi, bf, bt, bc = _bits(max(a[2] or 0, b[2] or 0)), _bits(max(a[3] or 0, b[3] or 0)), _bits(b[5]), _bits(caps.rows)
    if packed and low >= 0 and bc + bi + bf <= 61 and bc + bt <= 61:
        at = lambda i, f: F.shiftleft(F.col("cap"), bi + bf) + F.shiftleft(F.col(i).cast("bigint"), bf) + F.col(f)
        ends = links.df.select(at("image", "feature").alias("src"), at("image2", "feature2").alias("dst"))
        track = F.lit(1 << 62) + F.shiftleft(F.col("cap"), bt) + F.col("track_id")
        tied = seen.df.select(at("image", "feature").alias("src"), track.alias("dst"))
        first_track = F.lit(1 << 62)
        point = lambda c: (F.shiftright(c, bi + bf), F.shiftright(c, bf).bitwiseAND((1 << bi) - 1).cast("int"), F.col(c).bitwiseAND((1 << bf) - 1))
        numbers = None
    else:
        second = links.df.select("cap", F.col("image2").alias("image"), F.col("feature2").alias("feature"))
        points = links.df.select(*_POINT).unionByName(second).unionByName(seen.df.select(*_POINT)).filter("feature IS NOT NULL").distinct()
        numbers = s.write(dense_ids(points, "id", s)[0])
        tracks = s.write(dense_ids(seen.df.select("cap", "track_id").filter("track_id IS NOT NULL").distinct(), "t", s)[0])
        n2 = numbers.df.select("cap", F.col("image").alias("image2"), F.col("feature").alias("feature2"), F.col("id").alias("dst"))
        ends = links.df.join(numbers.df.withColumnRenamed("id", "src"), list(_POINT), "left").join(n2, ["cap", "image2", "feature2"], "left").select("src", "dst")
        key = ["cap", "track_id"]
        tied = skew_join(seen.df, tracks.df, key, "left", hot_keys(seen.df, key, seen.rows)).join(numbers.df, list(_POINT)).select(F.col("id").alias("src"), (F.col("t") + numbers.rows).alias("dst"))
        first_track = F.lit(numbers.rows)
    both = ends.unionByName(tied)
    if numbers is not None:
        both = s.write(both).df
    stars, _ = star_components(both)
    stars = s.write(stars.filter(F.col("hi") < first_track)).df if numbers is not None else stars.filter(F.col("hi") < first_track)
    linked = stars.select(F.col("hi").alias("point"), F.col("lo").alias("top"))
    tops = _tops(both, linked, first_track)
    every = linked.unionByName(tops.select("point", F.col("point").alias("top")))
    if numbers is None:
        p, t = point("point"), point("top")
        flat = every.select(p[0].alias("cap"), p[1].alias("image_idx"), p[2].alias("feature_idx"), t[1].alias("group_image_idx"), t[2].alias("group_feature_idx"))
    else:
        top = numbers.df.select(F.col("id").alias("top"), F.col("image").alias("group_image_idx"), F.col("feature").alias("group_feature_idx"))
        own = numbers.df.select(F.col("id").alias("point"), "cap", F.col("image").alias("image_idx"), F.col("feature").alias("feature_idx"))
        e = s.write(every)
        flat = skew_join(e.df, top, ["top"], "inner", hot_keys(e.df, ["top"], e.rows)).join(own, "point")
    flat_w = s.write(flat.select("cap", "image_idx", "feature_idx", "group_image_idx", "group_feature_idx"))
    named = skew_join(flat_w.df, caps.df, ["cap"], "inner", hot_keys(flat_w.df, ["cap"], flat_w.rows))
    return named.select("capture", F.col("image_idx").cast("int").alias("image_idx"), F.col("feature_idx").cast("bigint").alias("feature_idx"), F.col("group_image_idx").cast("int").alias("group_image_idx"), F.col("group_feature_idx").cast("bigint").alias("group_feature_idx"))


def _tops(both: DataFrame, linked: DataFrame, first_track) -> DataFrame:
    """Keypoints that name their group: the centres of stars, and those that nothing is linked to.

    ``both`` has each observation of a track as an edge, so only the ends of edges with a null or equal other end can be
    missing from the stars.
    """
    alone = both.filter("src IS NULL OR dst IS NULL OR src = dst").select(F.coalesce("src", "dst").alias("point"))
    centres = linked.select(F.col("top").alias("point"))
    own_track = both.filter(F.col("dst") >= first_track).select(F.col("src").alias("point"))
    return alone.unionByName(centres).unionByName(own_track).filter("point IS NOT NULL").distinct().join(linked.select("point"), "point", "left_anti")


