"""Joins and latest-row selection that stay balanced under hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Below this many rows a key is never hot: one task takes them with ease.
HOT_FLOOR = 200_000
#: A table of that many partitions or more may leave a key unsplit up to an average partition; so the list of hot keys is
#: bounded whatever the table.
HOT_SHARE = 50_000
#: Rows of a key at the limit that a sample should hold, so that none is missed.
SEEN = 500
#: Bytes of dimension rows of hot keys that may be broadcast; beyond that they are split by salt.
MAX_BROADCAST = 16 << 20
#: Hot keys that are listed in the plan itself; a longer list is a stored table.
_LISTED = 1000


@dataclass
class HotKeys:
    """The hot keys of a table, each with ``_n``, about how many rows it has; at most ``2 * HOT_SHARE``."""

    df: DataFrame | None
    keys: list[str]
    counts: list[tuple]
    limit: int = HOT_FLOOR

    def __bool__(self) -> bool:
        return bool(self.counts)


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int, floor: int = HOT_FLOOR, share: int = HOT_SHARE) -> HotKeys:
    """Keys with more than ``max(floor, rows / share)`` rows; nulls are no key.

    Where the limit is large the keys are counted on a sample, whose size grows with the number of keys that can be hot: a
    key at the limit has ``SEEN`` sampled rows on average and counts as hot from 0.7 of them, so practically none is missed.
    The list says which keys to treat apart, never what the result is. It has at most ``1.5 * share`` rows, which is the
    bound under which it is collected.
    """
    keys = list(keys)
    limit = max(floor, rows // share)
    if rows <= limit:
        return HotKeys(None, keys, [], limit)
    df = df.select(*keys).dropna()
    part = min(1.0, SEEN / limit)
    if part < 0.5:
        df, scale, least = df.sample(fraction=part, seed=7), 1 / part, 0.7 * SEEN
    else:
        scale, least = 1, limit
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).withColumn("_n", F.ceil(F.col("_n") * scale).cast("bigint"))
    found = [tuple(r) for r in got.collect()]
    if not found:
        return HotKeys(None, keys, [], limit)
    local = df.sparkSession.createDataFrame(found, got.schema)
    if len(found) > _LISTED:
        from skerry.runtime import Scratch

        local = Scratch(df.sparkSession).write(local.coalesce(1)).df
    return HotKeys(F.broadcast(local), keys, found, limit)


def _width(schema: T.StructType) -> int | None:
    """Bytes of a row if every column has a fixed width."""
    size = 0
    for f in schema.fields:
        if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            size += 16
        else:
            return None
    return size


def salted(df: DataFrame, on: Sequence[str], hot: HotKeys, salt: str = "_salt") -> DataFrame:
    """Rows of hot keys with a number below the parts that their key is split into: a hash of the row and its partition,
    so that repeated rows spread too."""
    parts = F.ceil(F.col("_n") / F.lit(max(1, hot.limit // 2)))
    return df.join(hot.df, list(on)).withColumn(salt, F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), parts)).drop("_n")


def skew_join(rows: DataFrame, dims: DataFrame, on: Sequence[str], how: str, hot: HotKeys) -> DataFrame:
    """``rows JOIN dims`` (inner or left) where ``dims`` has one row per key and a few keys hold much of ``rows``.

    Rows of keys that are not hot take the ordinary shuffled join. For hot keys the matching dims are broadcast if their
    rows have a fixed width and stay below ``MAX_BROADCAST`` bytes together; else their rows are split by salt and their
    dims repeated for each part. ``rows`` is read twice, so it should be a stored table.
    """
    on = list(on)
    if not hot:
        return rows.join(dims, on, how)
    key = hot.df.select(*on)
    cold = rows.join(key, on, "left_anti").join(dims, on, how)
    width = _width(dims.schema)
    if width is not None and width * len(hot.counts) <= MAX_BROADCAST:
        return rows.join(key, on, "left_semi").join(F.broadcast(dims.join(key, on, "left_semi")), on, how).unionByName(cold)
    parts = F.ceil(F.col("_n") / F.lit(max(1, hot.limit // 2)))
    spread = dims.join(hot.df, on).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_n")
    return salted(rows, on, hot).join(spread, [*on, "_salt"], how).drop("_salt").unionByName(cold)


def latest(df: DataFrame, keys: Sequence[str], by: str, keep: Sequence[str], tie: Sequence[Column | str] = ()) -> DataFrame:
    """For each key the ``keep`` columns of the row with the greatest ``by`` (null counts as earliest).

    Equal ``by`` values are settled by a hash of the kept columns (or by ``tie``), so every run picks the same row. Done
    as an aggregate with map-side combine: a key with a third of all rows is reduced before the shuffle.
    """
    # maps have no hash of their own
    plain = [F.array_sort(F.map_entries(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in keep]
    tie = list(tie) or [F.xxhash64(*plain)]
    value = F.struct(*[F.col(c) for c in keep])
    order = F.struct(F.col(by).alias("_o"), *[(F.col(t) if isinstance(t, str) else t).alias(f"_t{i}") for i, t in enumerate(tie)])
    got = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.max_by(value, order).alias("_v"))
    return got.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in keep])
