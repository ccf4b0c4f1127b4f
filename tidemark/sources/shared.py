"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: What the driver keeps of the plan of a scratch table's job, for its history of queries: characters in all, and fields of a node.
PLAN_TEXT = {"spark.sql.maxPlanStringLength": "4096", "spark.sql.debug.maxToStringFields": "4"}


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Jobs run within keep little text of their plans on the driver, which remembers a thousand; the session's settings come back afterwards."""
    old = {k: spark.conf.get(k) for k in PLAN_TEXT}
    for k, v in PLAN_TEXT.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a temporary folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return d


#: Scratch tables from one time that the driver gives memory back to the next.
EVERY = 10
_saved = itertools.count(1)


def trim() -> None:
    """Give back what this process no longer needs: garbage, and what Arrow and the C library keep of freed memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    found = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if found:
        found(0)


def give_back(spark: SparkSession) -> None:
    """`trim` for the driver, its JVM included: compilers and buffers leave much behind there, and shuffles of earlier rounds stay until it collects garbage."""
    trim()
    lang = spark._jvm.java.lang
    lang.System.gc()
    with suppress(Py4JError):  # a JVM that has no such command
        invoke = next(m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(lang.Object, 4)
        args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), args)


class Scratch:
    """Intermediate tables as Parquet in the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        with short_plans(self.spark):
            df.write.mode("overwrite").parquet(path)
        if next(_saved) % EVERY == 0:
            give_back(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete saved tables that no later step reads."""
        for df in dfs:
            self._delete(df._tidemark_path)

    def clear(self) -> None:
        """Delete all saved tables."""
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
