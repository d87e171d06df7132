"""Cutting lineage: tables written once to the shared folder and read again.

Tables go to the folder of spark.checkpoint.dir.  Where that is unset a local session gets a folder of its own, and any other
session an error, because its executors wouldn't see each other's files.  A ``Scratch`` deletes the tables that an operator has done
with; tables that a result still reads are deleted when the driver's Python ends."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    global _own_dir
    sc = spark.sparkContext
    if where := sc.getConf().get("spark.checkpoint.dir"):
        return where.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="folium-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when the driver's Python ends if it hasn't been before."""
    if not _kept:
        atexit.register(_delete_kept, spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _kept.discard(path)


def _delete_kept(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may have gone before
            for path in list(_kept):
                delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a Parquet table in the shared folder; lineage starts anew there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are deleted one by one, or when the block is left; nothing that is read later may depend on them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.done(*list(self.paths))

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths[path] = None
        df.write.parquet(path)
        self.paths[path] = found = self.spark.read.schema(df.schema).parquet(path)
        return found

    def counted(self, df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
        """The written table, and how many of its rows meet a condition, counted while it is written."""
        seen = Observation()
        found = self.written(df.observe(seen, F.count(F.when(condition, 1)).alias("n")), name)
        return found, seen.get["n"]

    def done(self, *tables: DataFrame | str) -> None:
        """Deletes tables (or paths) that nothing will read again."""
        for path in [p for p, t in self.paths.items() if any(p == x if isinstance(x, str) else t is x for x in tables)]:
            delete(self.spark, path)
            del self.paths[path]


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    return written(df, name)
