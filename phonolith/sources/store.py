"""What is kept between steps: results read more than once, JSON results and CSV tables."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once(df: DataFrame) -> DataFrame:
    """A result that is read more than once, checkpointed in ``spark.checkpoint.dir`` (where that is unset, on a local
    master, in a folder of this process), so it is computed once and survives the loss of executors.

    Raises ValueError on a cluster without the setting: its executors would each write to a disk of their own.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="phonolith-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; columns that CSV can't hold (arrays, maps, structs) are left out."""
    flat = [n for n, t in rows.dtypes if not t.startswith(("array", "map", "struct", "variant", "binary"))]
    rows.select(*flat).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def merge_json(spark: SparkSession, path: str, values: dict) -> dict:
    """Set keys of a JSON file of results; keys of other writers stay. The file is small and on any file system Spark knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    old = json.loads(spark.read.text(path, wholetext=True).first().value) if files.exists(where) else {}
    merged = old | values
    out = files.create(where, True)
    out.write(json.dumps(merged, ensure_ascii=False, indent=1).encode())
    out.close()
    return merged


def not_done(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a stopped job still has to do."""
    return wanted.join(done, [*keys], "left_anti")


def speakers_list(rows: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Speakers of a corpus table with trimmed lower-case text columns, of the wanted native languages."""
    clean = rows.select(*[F.lower(F.trim(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    return clean.where(F.col("native_language").isin(*[x.lower() for x in languages]))
