"""Structural and value constraints of stored tables, all checked in one pass and reported together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Families of declared types (fixed values).
FAMILIES = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "bool": (T.BooleanType,),
    "str": (T.StringType,),
}


@dataclass(frozen=True)
class Field:
    """A declared column: a type name (``double``) or family (``float``); ``optional`` ones may be absent."""

    name: str
    kind: str
    optional: bool = False


def structural_problems(df: DataFrame, fields: Sequence[Field]) -> list[str]:
    """All ways in which the schema falls short. Undeclared columns are allowed (see :func:`extras`)."""
    out = []
    for f in fields:
        if f.name not in df.columns:
            if not f.optional:
                out.append(f"{f.name}: missing")
            continue
        got = df.schema[f.name].dataType
        if not (isinstance(got, FAMILIES[f.kind]) if f.kind in FAMILIES else got.simpleString() == f.kind):
            out.append(f"{f.name}: {got.simpleString()}, declared {f.kind}")
    return out


def extras(df: DataFrame, fields: Sequence[Field]) -> list[str]:
    known = {f.name for f in fields}
    return [c for c in df.columns if c not in known]


def _nan(c: str) -> Column:
    return F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False))


@dataclass(frozen=True)
class NoNaN:
    column: str

    def measure(self) -> Column:
        return F.count_if(_nan(self.column)).alias(f"{self.column}_nan")

    def holds(self, v) -> bool:
        return v == 0


@dataclass(frozen=True)
class Finite:
    column: str

    def measure(self) -> Column:
        return F.count_if(_nan(self.column) | (F.abs(F.col(self.column).cast("double")) == float("inf"))).alias(f"{self.column}_nonfinite")

    def holds(self, v) -> bool:
        return v == 0


@dataclass(frozen=True)
class Within:
    """Values lie between the bounds; NaN passes, as it is the business of :class:`NoNaN`."""

    column: str
    least: float | None = None
    most: float | None = None

    def measure(self) -> Column:
        c = F.col(self.column)
        bad = F.lit(False)
        if self.least is not None:
            bad = bad | (c < self.least)
        if self.most is not None:
            bad = bad | (c > self.most)
        return F.count_if(~_nan(self.column) & bad).alias(f"{self.column}_outside")

    def holds(self, v) -> bool:
        return v == 0


@dataclass(frozen=True)
class MaxPlusOne:
    """The largest number of a dense id column is one less than the declared count (gaps pass, and so does an empty table)."""

    column: str
    count: int

    def measure(self) -> Column:
        return F.coalesce(F.max(self.column) + 1 == self.count, F.lit(True)).alias(f"{self.column}_dense")

    def holds(self, v) -> bool:
        return bool(v)


@dataclass(frozen=True)
class NonEmpty:
    def measure(self) -> Column:
        return (F.count(F.lit(1)) > 0).alias("nonempty")

    def holds(self, v) -> bool:
        return bool(v)


def report(df: DataFrame, rules: Sequence) -> DataFrame:
    """One row with the row count and what each rule measured; one scan that reads only the columns of the rules."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[r.measure() for r in rules])


def problems(df: DataFrame, fields: Sequence[Field], rules: Sequence = ()) -> list[str]:
    """Structure first; values only if the structure holds. All problems together."""
    found = structural_problems(df, fields)
    if found or not rules:
        return found
    row = report(df, rules).first()
    return [f"{type(r).__name__}: {name} = {row[name]}" for r, name in zip(rules, row.__fields__[1:]) if not r.holds(row[name])]
