"""Deeply nested records as related flat tables.

Children are emitted from Arrow list buffers: a list's offsets give each element its parent row and its position, and keys
follow by vectorised ``take``. No row is walked in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skerry.runtime import Scratch


def list_children(arr: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Elements of a list array, the row each belongs to, and its position there. Null and empty lists have none."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    parent = pc.list_parent_indices(arr).to_numpy(zero_copy_only=False).astype(np.int64)
    length = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(length) - length
    return pc.list_flatten(arr), parent, np.arange(len(parent)) - start[parent]


def descend(arr: pa.Array, path: Sequence[str]) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """Follows ``path`` through structs and lists: a name enters a struct field, ``[]`` the elements of a list.

    Returns the values at its end, the top row of each and its position in each list passed. Absent structs have no
    values.
    """
    rows, at = np.arange(len(arr)), []
    for step in path:
        if step == "[]":
            arr, parent, pos = list_children(arr)
            rows, at = rows[parent], [x[parent] for x in at] + [pos]
        else:
            arr = pc.struct_field(arr, step)
    return arr, rows, at


def _flat_fields(dt: T.DataType, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    if isinstance(dt, T.StructType):
        return [x for f in dt.fields for x in _flat_fields(f.dataType, (*at, f.name))]
    return [] if isinstance(dt, T.ArrayType) else [(at, dt)]


def list_paths(dt: T.DataType, at: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Every list below a type, outermost first."""
    if isinstance(dt, T.StructType):
        return [x for f in dt.fields for x in list_paths(f.dataType, (*at, f.name))]
    if isinstance(dt, T.ArrayType):
        return [(*at, "[]"), *list_paths(dt.elementType, (*at, "[]"))]
    return []


def _type_at(dt: T.DataType, path: Sequence[str]) -> T.DataType:
    for step in path:
        dt = dt.elementType if step == "[]" else dt[step].dataType
    return dt


def flatten(df: DataFrame, keys: Sequence[str], column: str) -> dict[str, DataFrame]:
    """One flat table for each list below ``column``, named by its path (``groups[].metrics[]``).

    A table has the key columns, one position column for each list on the way (``at_1``, ``at_2``, ...), and the scalar
    fields of its elements under ``v_`` and their path. (keys, all positions but the last) is the parent's key, so the
    tables join back to each other. All tables are written in one pass over the source, into the shared folder.

    Defined cases: null or empty lists and absent structs have no rows; a null element keeps its position and has a row of
    nulls; an empty table gives empty tables; the prefixes keep field names from clashing with key names, and columns
    other than keys and ``column`` are ignored. Keys may be null or repeated: rows are carried as they are.
    """
    keys = list(keys)
    dt = df.schema[column].dataType
    lists = []
    for i, path in enumerate(list_paths(dt)):
        fields = _flat_fields(_type_at(dt, path))
        kind = T.StructType([T.StructField("v" + "".join(f"_{x}" for x in f), t) for f, t in fields] or [T.StructField("v", T.BooleanType())])
        lists.append((f"t{i}", path, [f for f, _ in fields], kind))
    if not lists:
        return {}
    schema = T.StructType(
        [T.StructField("_list", T.StringType())]
        + [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
        + [T.StructField("_at", T.ArrayType(T.IntegerType()))]
        + [T.StructField(n, k) for n, _, _, k in lists]
    )
    src = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(column).alias("_c"))
    got = Scratch(df.sparkSession).write(src.mapInArrow(_emitter([x[:3] for x in lists], len(keys), schema), schema), by=["_list"]).df
    out = {}
    for n, path, fields, kind in lists:
        at = [F.col("_at")[i].alias(f"at_{i + 1}") for i in range(sum(p == "[]" for p in path))]
        own = got.filter(F.col("_list") == n).select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *at, *([f"{n}.{f.name}" for f in kind.fields] if fields else []))
        out["".join(("." if p != "[]" and i else "") + p for i, p in enumerate(path))] = own
    return out


def _emitter(lists: Sequence[tuple[str, Sequence[str], Sequence[tuple[str, ...]]]], n_keys: int, schema: T.StructType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for b in batches:
            for name, path, fields in lists:
                values, rows, at = descend(b.column(n_keys), path)
                idx = pa.array(rows)
                cols = {"_list": pa.array([name] * len(rows), pa.string())} | {f"_k{i}": b.column(i).take(idx) for i in range(n_keys)}
                places = np.stack(at, 1).astype(np.int32)
                cols["_at"] = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * places.shape[1]), pa.array(places.ravel()))
                own = []
                for f in fields:
                    v = values
                    for step in f:
                        v = pc.struct_field(v, step)
                    own.append(v)
                kind = target.field(name).type
                cols[name] = pa.StructArray.from_arrays([v.cast(t.type) for v, t in zip(own, kind)], fields=list(kind)) if own else pa.nulls(len(rows), kind)
                yield pa.RecordBatch.from_arrays([(cols[t.name] if t.name in cols else pa.nulls(len(rows), t.type)).cast(t.type) for t in target], schema=target)

    return run
