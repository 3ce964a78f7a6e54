"""Durable intermediate tables.

Lineage is cut by writing a Parquet table into the folder that every executor shares, named by
``spark.checkpoint.dir``. Nothing here lives only in executor memory, so a lost executor costs a re-read.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's own folder below ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            base = "file://" + tempfile.mkdtemp(prefix="shoebox-")
            atexit.register(_remove_local, base[len("file://"):])
        _ROOTS[app] = f"{base.rstrip('/')}/shoebox-{uuid.uuid4().hex}"
    return _ROOTS[app]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, *, sort_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage, gives later joins true sizes)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df_path: str, spark: SparkSession) -> None:
    """Remove one scratch table that no pending plan reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
