"""One group for all records that are linked directly or indirectly: large-star and small-star rewrites in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.plans.skew import hot_keys, skew_join
from skerry.runtime import Scratch, Written


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    """Every edge (hi, lo) becomes (hi, smallest of lo and its neighbours).

    Only edges in which lo is the larger end can lower it, so the minimum is taken over those. lo is the end that grows hot
    (the centre of a star), and hot ends get their minimum by a bounded broadcast instead of a shuffle.
    """
    least = e.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
    return skew_join(e, least, ["lo"], "left", hot_keys(e, ["lo"], rows)).select("hi", F.coalesce("m", "lo").alias("lo"))


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    """At every hi, its smaller neighbours and itself are tied to the smallest of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    tied = skew_join(e.select("hi", "lo"), least, ["hi"], "inner", hot_keys(e, ["hi"], rows))
    # (hi, m) where lo is the minimum itself, else (lo, m); so each edge gives one row
    return tied.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct()


def _settle(e: Written, s: Scratch) -> Written:
    """Adds ``live``: false for the edges of groups that are stars already, which no later rewrite would change.

    A hi is loose if it has several lo or is a lo itself. A star is settled if none of its leaves is loose and its centre is
    no hi; then no edge leads out of it.
    """
    his = e.df.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
    los = e.df.select(F.col("lo").alias("hi")).distinct().withColumn("is_lo", F.lit(True))
    loose = s.write(his.join(los, "hi", "left").filter("n > 1 OR is_lo").select("hi", F.coalesce("is_lo", F.lit(False)).alias("is_lo")))
    if not loose.rows:
        s.drop(loose)
        return s.write(e.df.withColumn("live", F.lit(False)))
    centres = e.df.join(loose.df, "hi", "left_semi").select("lo").unionByName(loose.df.filter("is_lo").select(F.col("hi").alias("lo"))).distinct()
    out = s.write(skew_join(e.df, centres.withColumn("_live", F.lit(True)), ["lo"], "left", hot_keys(e.df, ["lo"], e.rows)).select("hi", "lo", F.col("_live").isNotNull().alias("live")))
    s.drop(loose)
    return out


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, int]:
    """``hi, lo``: every record but the smallest of its group once, with that smallest; and the number of rounds.

    ``edges`` links records by whole numbers. Rounds alternate both rewrites until all groups are stars around their
    minimum, which is the state that neither rewrite changes; groups that are stars already sit out the later rounds.
    Each round is a few distributed joins over a written table; no group, component or neighbourhood is gathered in one
    task.

    Defined cases: an edge with a null end or two equal ends links nothing; repeated and reversed edges count once; an
    empty table gives an empty result; extra columns are ignored.
    """
    s = Scratch(edges.sparkSession)
    a, b = F.col(src).cast("bigint"), F.col(dst).cast("bigint")
    e = s.write(edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    rounds = 0
    done: DataFrame | None = None
    while True:
        rounds += 1
        small = s.write(_small_star(e.df, e.rows))
        s.drop(e)
        if rounds == 1:
            # chains of raw links are rarely stars after one rewrite
            e = s.write(_large_star(small.df, small.rows))
            s.drop(small)
            continue
        both = _settle(small, s)
        s.drop(small)
        stars = both.df.filter("NOT live").select("hi", "lo")
        done = stars if done is None else done.unionByName(stars)
        live = both.df.filter("live").select("hi", "lo")
        rows = live.count()
        if not rows:
            return done, rounds
        e = s.write(_large_star(live, rows))


def consolidate(pairs: DataFrame, src: str = "src", dst: str = "dst", records: DataFrame | None = None, record: str = "record") -> DataFrame:
    """``record, group``: every record of ``pairs`` and of ``records`` with the smallest record it is linked to.

    Records that no pair links are groups of their own, also those that appear only in pairs with a null or equal end.
    """
    stars, _ = star_components(pairs, src, dst)
    named = pairs.select(F.explode(F.array(F.col(src).cast("bigint"), F.col(dst).cast("bigint"))).alias("record"))
    if records is not None:
        named = named.unionByName(records.select(F.col(record).cast("bigint").alias("record")))
    named = named.filter("record IS NOT NULL").distinct()
    return named.join(stars.select(F.col("hi").alias("record"), "lo"), "record", "left").select("record", F.coalesce("lo", "record").alias("group"))
