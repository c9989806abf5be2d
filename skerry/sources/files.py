"""File formats of reconstructions as tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def images(spark: SparkSession, folder: str, glob: str = "*.{png,jpg,jpeg,PNG,JPG,JPEG}") -> DataFrame:
    """``path, name, length`` of image files by suffix; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def json_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON result files with a declared schema; no file gives an empty table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    got = fs.globStatus(p)
    return spark.read.schema(schema).json(path) if got is not None and len(got) else spark.createDataFrame([], schema)


def depth_maps(spark: SparkSession, path: str) -> DataFrame:
    """``path, px, py, depth`` of maps stored as ``width&height&channels&`` and float32 values, row by row, first channel."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, data in zip(p["path"], p["content"]):
                w, h, c, rest = bytes(data).split(b"&", 3)
                w, h, c = int(w), int(h), int(c)
                a = np.frombuffer(rest, "<f4", count=w * h * c).reshape(c, h, w)[0] if c > 1 else np.frombuffer(rest, "<f4", count=w * h).reshape(h, w)
                step = max(1, 200_000 // max(w, 1))
                for y0 in range(0, h, step):
                    b = a[y0 : y0 + step]
                    yy, xx = np.mgrid[y0 : y0 + b.shape[0], 0:w]
                    yield pd.DataFrame({"path": name, "px": xx.ravel().astype("int32"), "py": yy.ravel().astype("int32"), "depth": b.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, px int, py int, depth float")



def ply_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, format, vertices, properties`` from the head of each file, however long it is."""
    head = F.substring_index(F.col("content").cast("string"), "end_header", 1)
    props = F.transform(F.regexp_extract_all(head, F.lit(r"property\s+(\w+)\s+(\w+)"), F.lit(2)), lambda x: x)
    return spark.read.format("binaryFile").load(path).select(
        "path",
        F.regexp_extract(head, r"format\s+(\S+)", 1).alias("format"),
        F.regexp_extract(head, r"element vertex\s+(\d+)", 1).cast("bigint").alias("vertices"),
        props.alias("properties"),
    )


def write_ply(points: DataFrame, path: str, comments: Sequence[str] = ()) -> int:
    """Writes ``x, y, z[, r, g, b]`` as one binary PLY file, without rows that are not finite; returns the rows written.

    Rows are streamed through the driver one partition at a time, as the format is a single file; the engine's own
    storage of points is Parquet.
    """
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    rgb = all(c in points.columns for c in "rgb")
    src = points.filter(ok).select("x", "y", "z", *(["r", "g", "b"] if rgb else []))
    n, fmt = src.count(), struct.Struct("<fff" + ("BBB" if rgb else ""))
    lines = ["ply", "format binary_little_endian 1.0", *[f"comment {c}" for c in comments], f"element vertex {n}", *[f"property float {c}" for c in "xyz"]]
    lines += [f"property uchar {c}" for c in ("red", "green", "blue")] if rgb else []
    with open(path, "wb") as f:
        f.write(("\n".join([*lines, "end_header"]) + "\n").encode())
        for r in src.toLocalIterator():
            f.write(fmt.pack(*r))
    return n


def pose_text(spark: SparkSession, path: str) -> DataFrame:
    """Poses of an ``images.txt``: ``image_idx, qw, qx, qy, qz, t0, t1, t2, camera_idx, name``; comments and point lines are
    skipped."""
    f = F.split(F.trim("value"), r"\s+")
    ok = (~F.col("value").startswith("#")) & (F.size(f) == 10) & F.col("value").rlike(r"^\s*\d+\s+-?[\d.eE+-]+\s")
    names = ["qw", "qx", "qy", "qz", "t0", "t1", "t2"]
    return spark.read.text(path).filter(ok).select(f[0].cast("int").alias("image_idx"), *[f[i + 1].cast("double").alias(n) for i, n in enumerate(names)], f[8].cast("int").alias("camera_idx"), f[9].alias("name"))


def projection_text(spark: SparkSession, path: str) -> DataFrame:
    """3 x 4 projection matrices, one file each, as ``path, m`` (twelve numbers)."""
    n = F.filter(F.split(F.trim(F.regexp_replace("value", r"[^0-9eE.+\-]+", " ")), r"\s+"), lambda x: x.rlike(r"^[-+]?\d"))
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.transform(n, lambda x: x.cast("double")).alias("m")).filter(F.size("m") == 12)


def pose_export(poses: DataFrame) -> DataFrame:
    """Lines of an ``images.txt`` for valid poses given as quaternions."""
    return poses.filter("valid").select(F.format_string("%d %.9f %.9f %.9f %.9f %.9f %.9f %.9f %d %s", *[F.col(c) for c in ("image_idx", "qw", "qx", "qy", "qz", "t0", "t1", "t2", "camera_idx", "name")]).alias("value"))


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """Cells of pipe tables: ``path, line, section, cells``. A heading opens a section; rule lines are left out."""
    lines = F.posexplode(F.split("value", "\n")).alias("line", "text")
    t = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), lines)
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line")  # lines of one document
    t = t.withColumn("section", F.last(F.when(F.col("text").rlike(r"^#+\s"), F.regexp_replace("text", r"^#+\s+", "")), ignorenulls=True).over(w))
    row = F.col("text").rlike(r"^\s*\|.*\|\s*$") & ~F.col("text").rlike(r"^[\s|:\-]+$")
    return t.filter(row).select("path", "line", "section", F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)).alias("cells"))
