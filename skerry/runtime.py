"""Session, shared folder and written tables.

Loops over DataFrames cut their lineage by writing each round as a Parquet table into the folder that every executor
shares (``spark.checkpoint.dir``). A written table survives the loss of any executor, is compressed, keeps column pruning
and gives its row count from the footers.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "skerry", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, bring your own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset on a local master is a folder of this
    machine used; on any other master an unset folder is an error, because no local folder is visible to all executors.
    """
    sc = spark.sparkContext
    got = sc.getCheckpointDir()
    if got:
        return got
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="skerry-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        named = f"file://{named}"
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


@dataclass
class Written:
    """A table written to the shared folder."""

    df: DataFrame
    path: str
    rows: int


class Scratch:
    """Written tables of one operator call.

    ``write`` stores a DataFrame and returns the stored one. ``drop`` removes tables that later rounds no longer read;
    what is left when the session's JVM ends is removed then (results are lazy and may still read them until that time).
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = shared_dir(spark)

    def write(self, df: DataFrame, by: Sequence[str] = ()) -> Written:
        path = f"{self.root}/t-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
        back = self.spark.read.schema(df.schema).parquet(path)
        return Written(back, path, back.count())

    def keep(self, df: DataFrame) -> Written:
        """A table that is read several times: as it is if it is a plain scan, else stored."""
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if all(x.lstrip(" :+-").split(" ")[0].rstrip(",") in _SCANS for x in plan.splitlines() if x.strip(" :+-")):
            return Written(df, "", df.count())
        return self.write(df)

    def settle(self, result: DataFrame, *inputs: Written | None) -> DataFrame:
        """Stores a result and drops the stored tables it was made from."""
        out = self.write(result)
        self.drop(*inputs)
        return out.df

    def drop(self, *tables: Written | None) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            if t is not None and t.path:
                p = jvm.org.apache.hadoop.fs.Path(t.path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Steps of a plan that are cheap to repeat.
_SCANS = ("Project", "Filter", "Relation", "LogicalRelation", "LocalRelation")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Spreads a table over all cores before per-row Python work, if it comes in fewer partitions (few or large files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
