"""Tables written in the folder that the cluster shares, to cut lineage between the steps of an operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, on a local master, a folder of this process.

    Raises ValueError on a cluster without the setting: its executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="phonolith-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The files are there for every executor, so the loss of one loses nothing. Shuffle files of the job that writes
    are given back when it ends. The table goes with ``forget()``, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phonolith/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    gone_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._phonolith_path = path
    return out


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder that is there deleted when the driver's JVM ends."""
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``written()`` made and nothing reads any more."""
    at, files = _hadoop(df.sparkSession, df._phonolith_path)
    files.delete(at, True)
