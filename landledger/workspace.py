"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``.  A session on one machine that names none gets a folder of
    this process, removed at its end; a cluster must name one, as its machines don't share local folders."""
    global _own_dir
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return f"{set_by_cluster.rstrip('/')}/landledger-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="landledger-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Through the file system of the path, so any store that Spark writes to."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def materialise(df: DataFrame, label: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    That cuts the lineage: what follows survives the loss of any executor without redoing ``df``, and the planner knows its size.
    ``instead_of`` is an earlier table that nothing else will read; it is deleted once the new one is there.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if instead_of is not None and instead_of in _paths:
        delete(spark, _paths.pop(instead_of))
    return out


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """For eager work with many expressions a row: generated methods over 8000 bytes, which HotSpot would only interpret, are left for smaller ones.

    A setting of the session's own stays.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    own = spark.conf.get(name, None)
    if own is None:
        spark.conf.set(name, "8000")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)


#: Tables whose files are larger are not sent to every executor by a run.  Files of ids and keys take a twentieth of what their rows take in the driver.
LARGEST_BROADCAST = 1 << 20


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """For eager work over tables that grow: joins by size broadcast only what is small in the driver, too, not what merely has a small file.

    A setting of the session's own that is lower stays.
    """
    name = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(name, None)
    now = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if now > LARGEST_BROADCAST:
        spark.conf.set(name, str(LARGEST_BROADCAST))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


def clear(spark: SparkSession) -> None:
    """Delete all of this application's tables.  Results that read them must have been written by then."""
    delete(spark, shared_dir(spark))
