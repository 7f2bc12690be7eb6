"""Cuts of lineage that survive lost executors."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Cuts from one look at the driver's memory to the next, and the share of its largest heap that is left to finished jobs.
LOOK_EVERY, HEAP_SHARE = 6, 1 / 3


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, one is made, but only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factgrid-"))
    return context.getCheckpointDir().get()


def _delete(spark: SparkSession, path: str, now: bool) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if now:
        system.delete(jpath, True)
    else:
        system.deleteOnExit(jpath)


def clear_driver(spark: SparkSession) -> None:
    """Frees what finished jobs left on the driver: plans, broadcasts, shuffle files, and memory that malloc holds back.

    A JVM collects late and lets its heap grow to the limit instead, which a run of many small jobs reaches.
    """
    gc.collect()  # references from here keep plans alive there
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)
    with suppress(Py4JError):  # a JVM without that command
        text, new = jvm.java.lang.String, spark.sparkContext._gateway.new_array
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # By its interface, since the server's class is not open to callers.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        values = new(jvm.java.lang.Object, 4)
        values[0], values[1], values[2], values[3] = name, "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(text, 0)
        invoke.invoke(server, values)


def _look_at_driver(spark: SparkSession) -> None:
    context = spark.sparkContext
    context._factgrid_cuts = getattr(context, "_factgrid_cuts", 0) + 1
    if context._factgrid_cuts % LOOK_EVERY == 0:
        runtime = context._jvm.java.lang.Runtime.getRuntime()
        if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
            clear_driver(spark)


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back, so that later steps prune columns and know its size.

    The files go with discard(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(spark, path, now=False)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _look_at_driver(spark)
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of cuts that no frame will read again; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            _delete(df.sparkSession, path, now=True)
            df._cut_path = None
