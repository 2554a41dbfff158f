"""What the operators of this subpackage share: scratch tables in the cluster's shared folder, and null-safe inputs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RELEASE_SECONDS = 2


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or where that is unset in local mode a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="riskweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch = path
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing will read again; of another DataFrame there is nothing to delete."""
    scratch = df.__dict__.get("scratch")  # not getattr: a column may have that name
    if scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver notice which shuffles nothing refers to any more, and give executors the time to delete their files, so
    that these do not lie beside what is written next."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(RELEASE_SECONDS)


def release_memory() -> None:
    """Give what a Python worker no longer uses back to the system: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it or return it themselves
        ctypes.CDLL(None).malloc_trim(0)


def releasing(rows):
    """``rows`` (batches to batches) whose task starts and ends with little memory."""

    def run(batches):
        release_memory()
        yield from rows(batches)
        release_memory()

    return run


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that is no column of the frames (case aside)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_field(df: DataFrame, name: str, kind: str) -> str:
    """DDL of the columns of ``df`` and one more."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{name}` {kind}"])
