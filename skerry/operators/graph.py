"""Graphs over edge tables: components, tracks, ancestry, cycles of three images, lineage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.prefix import dense_ids
from skerry.plans.skew import hot_keys, skew_join
from skerry.runtime import Scratch, Written


#: Edges that one task solves at once: two whole numbers each, so some tens of MB.
ONE_TASK = 2_000_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges (u, v) of one partition: every node with the smallest it is connected to."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    ends = [t.column(c).to_numpy() for c in ("u", "v")]
    nodes = np.unique(np.concatenate(ends))
    u, v = (np.searchsorted(nodes, e) for e in ends)
    label = np.arange(len(nodes))
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while not np.array_equal(label, nxt := label[label]):
            label = nxt
    for lo in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 100_000]), pa.array(nodes[label[lo : lo + 100_000]])], names=["node", "component"])


def _contracted(e: Written, s: Scratch, one_task: int) -> DataFrame:
    """(node, component) of every node of the distinct edges (u, v), u < v."""
    if e.rows <= one_task:
        return e.df.repartition(1).mapInArrow(_solve, "node bigint, component bigint")
    both = s.write(e.df.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*"))
    near = s.write(both.df.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("up")))
    s.drop(both)
    up2 = near.df.select(F.col("node").alias("up"), F.col("up").alias("label"))
    to = s.write(skew_join(near.df, up2, ["up"], "inner", hot_keys(near.df, ["up"], near.rows)).select("node", "label"))
    half = s.write(skew_join(e.df, to.df.select(F.col("node").alias("u"), F.col("label").alias("a")), ["u"], "inner", hot_keys(e.df, ["u"], e.rows)).select("a", "v"))
    whole = skew_join(half.df, to.df.select(F.col("node").alias("v"), F.col("label").alias("b")), ["v"], "inner", hot_keys(half.df, ["v"], half.rows))
    rest = s.write(whole.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    s.drop(near, half, e)
    above = s.write(_contracted(rest, s, one_task)) if rest.rows else None
    if above is None:
        return to.df.select("node", F.col("label").alias("component"))
    top = above.df.select(F.col("node").alias("label"), "component")
    found = skew_join(to.df, top, ["label"], "left", hot_keys(to.df, ["label"], to.rows)).select("node", F.coalesce("component", "label").alias("component"))
    return s.settle(found, to, above)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, node: str = "node", one_task: int = ONE_TASK) -> DataFrame:
    """``node, component``: every node with the smallest node it is connected to (nodes are whole numbers).

    Contraction: every node takes the least neighbour of its least neighbour as label, edges are rewritten to labels, and
    those between equal labels leave, with them all groups that are done; so the graph shrinks from round to round. What
    is left of it when it has at most ``one_task`` edges is solved in one task. Labels are then handed down the rounds. State
    lies in written tables, dropped as they are used up; hot nodes are joined by :func:`skew_join`.

    Null ends link nothing, but the other end is a node; nodes of ``nodes`` without edges stand alone; repeated edges and
    equal ends are fine; an empty table gives an empty result.
    """
    s = Scratch(edges.sparkSession)
    a, b = F.col(src).cast("bigint"), F.col(dst).cast("bigint")
    raw = s.keep(edges.select(a.alias("a"), b.alias("b")))
    e = s.write(raw.df.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    found = s.write(_contracted(e, s, one_task))
    lone = raw.df.filter("a IS NULL OR b IS NULL OR a = b").select(F.coalesce("a", "b").alias("node"))
    if nodes is not None:
        lone = lone.unionByName(nodes.select(F.col(node).cast("bigint").alias("node")))
    lone = lone.filter("node IS NOT NULL").distinct().join(found.df.select("node"), "node", "left_anti")
    return found.df.unionByName(lone.select("node", F.col("node").alias("component")))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def build_tracks(links: DataFrame, policy: str = "drop", least: int = 2) -> DataFrame:
    """Tracks from links between keypoints (``scope, image_i, feature_i, image_j, feature_j``).

    Components of keypoints are track candidates. One that holds two keypoints of an image is conflicted: ``drop`` leaves it
    out, ``first`` keeps the smallest keypoint of each image. Candidates shorter than ``least`` are left out; the rest is
    numbered densely. Returns ``track_id, scope, image, feature``. Keypoints are told apart by (scope, image, feature).
    """
    if policy not in ("drop", "first"):
        raise ValueError(f"policy {policy!r}")
    s = Scratch(links.sparkSession)
    ok = s.write(links.dropna(subset=["scope", "image_i", "feature_i", "image_j", "feature_j"]).select("scope", "image_i", "feature_i", "image_j", "feature_j").distinct())
    key = ["scope", "image", "feature"]
    ends = ok.df.select("scope", F.explode(F.array(F.struct(F.col("image_i").alias("image"), F.col("feature_i").alias("feature")), F.struct(F.col("image_j").alias("image"), F.col("feature_j").alias("feature")))).alias("e")).select("scope", "e.*").distinct()
    ids = s.write(ends.withColumn("node", F.monotonically_increasing_id()))
    at = lambda x, n: ids.df.select("scope", F.col("image").alias(f"image_{x}"), F.col("feature").alias(f"feature_{x}"), F.col("node").alias(n))
    edges = ok.df.join(at("i", "src"), ["scope", "image_i", "feature_i"]).join(at("j", "dst"), ["scope", "image_j", "feature_j"]).select("src", "dst")
    obs = s.write(connected_components(edges).join(ids.df, "node").select("component", *key))
    s.drop(ok, ids)
    per = obs.df.groupBy("component", "scope", "image").agg(F.count(F.lit(1)).alias("n"), F.min("feature").alias("feature"))
    # a track is numbered by its first keypoint, so numbers are the same on every run
    head = F.min(F.struct("image", "feature")).alias("h")
    sizes = per.groupBy("component", "scope").agg(head, F.count(F.lit(1)).alias("images"), F.sum("n").alias("points"))
    sizes = sizes.filter(F.col("images") >= least) if policy == "first" else sizes.filter((F.col("images") == F.col("points")) & (F.col("points") >= least))
    good = s.write(sizes.select("component", "scope", "h.*"))
    numbers = good.df.join(dense_ids(good.df.select(*key), "track_id", s)[0], key).select("component", "track_id")
    k = s.write(per.select("component", *key)) if policy == "first" else obs
    chosen = skew_join(k.df, numbers, ["component"], "inner", hot_keys(k.df, ["component"], k.rows))
    return s.settle(chosen.select("track_id", *key), good, k, obs)


def inconsistent_rate(labels: DataFrame, group: str, frame: str) -> DataFrame:
    """Share of groups that hold a frame twice. One row."""
    g = labels.groupBy(group, frame).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg((F.max("n") > 1).cast("double").alias("bad"))
    return g.agg(F.avg("bad").alias("inconsistent_rate"))


def degrees(edges: DataFrame, src: str, dst: str, domain: DataFrame, node: str) -> DataFrame:
    """Edges at each node of the domain, 0 for isolated ones."""
    d = edges.select(F.explode(F.array(src, dst)).alias(node)).groupBy(node).agg(F.count(F.lit(1)).alias("_d"))
    return domain.select(node).distinct().join(d, node, "left").select(node, F.coalesce("_d", F.lit(0)).alias("degree"))


def bridges_between(edges: DataFrame, labels: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges whose ends carry different labels, by pair of labels."""
    j = edges.join(labels.select(F.col("node").alias(src), F.col("component").alias("a")), src).join(labels.select(F.col("node").alias(dst), F.col("component").alias("b")), dst)
    return j.filter("a <> b").groupBy(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).agg(F.count(F.lit(1)).alias("edges"))


def cycle_rates(links: DataFrame, near: float = 2.0, far: float = 40.0) -> DataFrame:
    """Chains i -> j -> k over triples of images that are linked all three ways, and how their end lies to the direct link.

    ``links`` has ``scope, seq, i, j, fi, fj, xi, yi, xj, yj``; per (scope, i, j, fi) the last ``seq`` counts, either way
    round. A chain end within ``near`` of the direct end closes the cycle by another feature (split), one ``far`` or more
    off merges two points; each triple counts in its three rotations. Returns ``chains, merged, split`` and the two rates, null
    without chains, in one row.
    """
    s = Scratch(links.sparkSession)
    back = links.select("scope", "seq", F.col("j").alias("i"), F.col("i").alias("j"), F.col("fj").alias("fi"), F.col("fi").alias("fj"), F.col("xj").alias("xi"), F.col("yj").alias("yi"), F.col("xi").alias("xj"), F.col("yi").alias("yj"))
    both = links.select(*back.columns).unionByName(back).dropna(subset=["fi", "fj"])
    last = s.write(both.groupBy("scope", "i", "j", "fi").agg(F.max_by(F.struct("fj", "xj", "yj"), F.struct("seq", "fj")).alias("t")).select("scope", "i", "j", "fi", "t.*")).df
    ab = last.select("scope", F.col("i").alias("a"), F.col("j").alias("b"), F.col("fi").alias("fa"), F.col("fj").alias("fb"))
    bc = last.select("scope", F.col("i").alias("b"), F.col("j").alias("c"), F.col("fi").alias("fb"), F.col("fj").alias("fc"), F.col("xj").alias("xc"), F.col("yj").alias("yc"))
    ac = last.select("scope", F.col("i").alias("a"), F.col("j").alias("c"), F.col("fi").alias("fa"), F.col("fj").alias("fd"), F.col("xj").alias("xd"), F.col("yj").alias("yd"))
    # rotations (i,j,k), (j,k,i), (k,i,j) of i < j < k
    turn = "(a < b AND b < c) OR (c < a AND a < b) OR (b < c AND c < a)"
    chains = ab.join(bc, ["scope", "b", "fb"]).filter(turn).join(ac, ["scope", "a", "c", "fa"])
    off = F.hypot(F.col("xc") - F.col("xd"), F.col("yc") - F.col("yd"))
    n = chains.agg(F.count(F.lit(1)).alias("chains"), F.count_if((F.col("fc") != F.col("fd")) & (off >= far)).alias("merged"), F.count_if((F.col("fc") != F.col("fd")) & (off <= near)).alias("split"))
    return n.withColumn("merge_rate", F.try_divide("merged", "chains")).withColumn("split_rate", F.try_divide("split", "chains"))


def leaves(produced: DataFrame, consumed: DataFrame, key: str) -> DataFrame:
    return produced.join(consumed.select(key).dropna().distinct(), key, "left_anti")


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """``child, ancestor, depth`` of every node, by doubling: each round joins the pairs found so far with themselves, so rounds
    grow with the logarithm of the depth. Nodes are no ancestors of their own, loops end."""
    s = Scratch(edges.sparkSession)
    c = s.write(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).dropna().distinct().filter("child <> ancestor"))
    size = lambda t: t.df.agg(F.sum("depth")).first()[0]
    was = (c.rows, size(c))
    while c.rows:
        up = c.df.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_top"), F.col("depth").alias("_d"))
        far = c.df.join(up, "ancestor").select("child", F.col("_top").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth")).filter("child <> ancestor")
        nxt = s.write(c.df.unionByName(far).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        s.drop(c)
        c, now = nxt, (nxt.rows, size(nxt))
        if now == was:
            break
        was = now
    return c.df


#: Ancestors that a row of :func:`_walks` holds.
_CHAIN = 8


def _walks(e: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Ancestors of all nodes where no node has two parents: ``_c, _up`` (the nearest ``_CHAIN`` ancestors of each node) and
    ``_c, _at, _off`` (the ancestor at every further multiple of ``_CHAIN``, from which its own row leads on), both by doubling;
    last the nodes ``_c`` whose way runs into a loop, if any: what the first two say of these repeats itself.

    Of the nodes with ``n`` ancestors or more some have exactly ``n`` unless they run into a loop, so if none ends in a
    doubling, all that are left do.
    """
    up = s.write(e.select("_c", F.array("_p").alias("_up")))
    n = 1
    while n < _CHAIN:
        far = up.df.select(F.col("_c").alias("_at"), F.col("_up").alias("_far")).hint("merge")
        on = up.df.filter(F.size("_up") == n).withColumn("_at", F.element_at("_up", n)).join(far, "_at", "left")
        nxt = s.write(on.select("_c", F.when(F.col("_far").isNull(), F.col("_up")).otherwise(F.concat("_up", "_far")).alias("_up")).unionByName(up.df.filter(F.size("_up") < n)))
        s.drop(up)
        up, n = nxt, 2 * n
    jump = s.write(up.df.filter(F.size("_up") == n).select("_c", F.element_at("_up", n).alias("_at")))
    hops, loops = jump.df.withColumn("_off", F.lit(n)), None
    while jump.rows:
        n *= 2
        far = jump.df.select(F.col("_c").alias("_at"), F.col("_at").alias("_far")).hint("merge")
        nxt = s.write(jump.df.join(far, "_at").select("_c", F.col("_far").alias("_at")))
        if nxt.rows == jump.rows:
            loops = nxt.df.select("_c")
            break
        if nxt.rows:
            on = hops.select(F.col("_c").alias("_at"), F.col("_at").alias("_far"), "_off").hint("merge")
            more = s.write(nxt.df.join(on, "_at").select("_c", F.col("_far").alias("_at"), (F.col("_off") + n).alias("_off")))
            hops = hops.unionByName(nxt.df.withColumn("_off", F.lit(n)))
            hops = hops.unionByName(more.df) if more.rows else hops
        jump = nxt
    return up.df, hops, loops


def ancestry(edges: DataFrame, child: str, parent: str, starts: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """``start, ancestor, depth``: everything the starts derive from, with the least number of steps, at most ``most`` if given.

    Where no node has two parents and half of the nodes or more are starts, the ways up are found by doubling, and the pairs are not
    written out. Else, and for starts whose way runs into a loop, breadth-first rounds over written tables; a pair seen before
    is not followed again, so loops end. No table is broadcast: the size of its files, by which Spark would choose, is far below
    that of its rows.
    """
    s = Scratch(edges.sparkSession)
    e = s.write(edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).dropna().distinct().filter("_c <> _p"))
    first = starts.select(F.col(start).alias("start")).dropna().distinct()
    if most is not None or not e.rows:
        return _rounds(e.df, first, most, s)
    first = s.write(first).df
    asked = first.select(F.col("start").alias("_c"), F.lit(True).alias("_s")).hint("merge")
    parents, nodes = e.df.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).join(asked, "_c", "left").agg(F.max("_n"), F.count("_s")).first()
    if parents > 1 or 2 * nodes < e.rows:
        return _rounds(e.df, first, most, s)
    up, hops, loops = _walks(e.df, s)
    near, far = up.withColumn("_off", F.lit(0)), hops
    for other, how in ((asked if nodes < e.rows else None, "left_semi"), (loops, "left_anti")):
        if other is not None:
            near, far = (x.join(other.hint("merge"), "_c", how) for x in (near, far))
    far = far.join(up.withColumnRenamed("_c", "_at").hint("merge"), "_at")
    out = near.select("_c", "_off", "_up").unionByName(far.select("_c", "_off", "_up"))
    out = out.select(F.col("_c").alias("start"), "_off", F.posexplode("_up").alias("_i", "ancestor")).select("start", "ancestor", (F.col("_off") + F.col("_i") + 1).alias("depth"))
    if loops is None:
        return out
    turning = first.join(loops.withColumnRenamed("_c", "start").hint("merge"), "start", "left_semi")
    return out.unionByName(_rounds(e.df.join(loops.hint("merge"), "_c", "left_semi"), turning, most, s))


def _rounds(e: DataFrame, starts: DataFrame, most: int | None, s: Scratch) -> DataFrame:
    """:func:`ancestry` by breadth-first rounds: ``e(_c, _p)`` and ``starts(start)``, distinct and without nulls."""
    e = s.keep(e).df.hint("merge")
    front = s.write(starts.select("start", F.col("start").alias("ancestor"), F.lit(0).alias("depth")))
    seen = front
    depth = 0
    while front.rows and (most is None or depth < most):
        depth += 1
        step = front.df.join(e, F.col("ancestor") == F.col("_c")).select("start", F.col("_p").alias("ancestor")).distinct()
        nxt = s.write(step.join(seen.df.select("start", "ancestor").hint("merge"), ["start", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if nxt.rows:
            all_ = s.write(seen.df.unionByName(nxt.df))
            if seen is not front:
                s.drop(seen)
            seen = all_
        front = nxt
    return seen.df.filter("depth > 0")


def diverge(left: DataFrame, right: DataFrame, on: Sequence[str], item: str) -> DataFrame:
    """Where two ancestries differ: keys with other items on either side, or on one side only."""
    j = left.select(*on, F.col(item).alias("left_item")).join(right.select(*on, F.col(item).alias("right_item")), list(on), "full_outer")
    return j.filter(~F.col("left_item").eqNullSafe(F.col("right_item")))


def latest_producer(outputs: DataFrame, artifact: str, order: str, step: str) -> DataFrame:
    return outputs.groupBy(artifact).agg(F.max_by(step, F.struct(order, step)).alias(step))


def lead_edges(df: DataFrame, group: Sequence[str], node: str) -> DataFrame:
    """Chain edges, one fewer than members, that link all members of each group."""
    w = Window.partitionBy(*group).orderBy(node)
    return df.select(*group, node).distinct().select(F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).filter("dst IS NOT NULL")
