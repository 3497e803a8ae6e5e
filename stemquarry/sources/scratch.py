"""Folders and tables that all machines of a session share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str = "files") -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the application ends.

    Where the session names no such folder, a local one (tests) gets a folder of its own; on a
    cluster that would be another folder on each machine: an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stemquarry-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/stemquarry-{name}-{uuid.uuid4().hex}"
    _LEFT.append((spark, folder))
    return folder


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read back: its lineage is cut, and nothing is kept on one machine only."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete all folders made so far.  Long sessions call it once they have written their results."""
    while _LEFT:
        spark, folder = _LEFT.pop()
        try:
            if spark.sparkContext._jsc is not None:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the application has ended; nothing to report to
            return
