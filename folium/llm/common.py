"""What the corpus operators share: the shared folder, written tables, code shipping, join keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import io
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import lineage
from ..plans.lineage import delete, new_path, shared_dir  # noqa: F401

#: White space of the word rules: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

#: Share of the heap's limit beyond which the driver's JVM is asked to shrink its heap; seconds between two such looks at the least.
HEAP, EVERY = 0.5, 2.0

_shipped: set[str] = set()
_tidied = [0.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches (long texts come in small batches) and puts this package on the executors' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        folder = tempfile.mkdtemp(prefix="folium-zip-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"folium_{uuid.uuid4().hex[:8]}.zip")
        Path(path).write_bytes(packed.getvalue())
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def give_back() -> None:
    """Returns memory that Arrow and malloc keep of what was freed to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(spark: SparkSession, every: float = EVERY) -> None:
    """Has the driver give back what it doesn't need: Python what it has freed, the JVM its heap if that has grown beyond ``HEAP`` of its
    limit, and what its malloc keeps. A JVM runs for long, with threads and heap of all plans so far, and gives nothing back by itself."""
    if time.monotonic() - _tidied[0] < every:
        return
    give_back()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP * runtime.maxMemory():
        jvm.java.lang.System.gc()
    with contextlib.suppress(Exception):  # only HotSpot on Linux has it, from 17.0.9 on
        types = gateway.new_array(jvm.java.lang.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = jvm.java.lang.Class.forName(name)
        call = gateway.new_array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, call)
    _tidied[0] = time.monotonic()


def written(df: DataFrame, name: str) -> DataFrame:
    """lineage.written, after which the driver is tidied."""
    found = lineage.written(df, name)
    tidy(df.sparkSession)
    return found


class Scratch(lineage.Scratch):
    """lineage.Scratch; the driver is tidied after each table."""

    def written(self, df: DataFrame, name: str) -> DataFrame:
        found = super().written(df, name)
        tidy(self.spark)
        return found


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, whose worker gives back what it has freed: Arrow's memory after each batch, all of it when the task ends.
    Workers stay idle for later stages, beside a JVM that keeps its heap."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield batch
                del batch
                pa.default_memory_pool().release_unused()
        finally:
            give_back()

    return task


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def skew_key(column: str | Column) -> Column:
    """The same key as a new expression: a join on it after groupBy gets an exchange of its own on both
    sides, which is what adaptive execution needs in order to split a hot partition."""
    c = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(""), c.cast("string"))
