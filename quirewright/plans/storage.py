"""Where intermediate tables go.

The folder comes from ``spark.checkpoint.dir``; only where that is unset (local tests) a folder of
the machine is made. Tables are written as Parquet, so they are compressed, can be read with pruned
columns, and survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Unset on a cluster is an error, as a folder of one machine would lose data there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="quirewright-")
        atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
    return f"file://{_LOCAL[key]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has written; the number. Results that still read them become invalid."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder: ``<folder>/<name>.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
