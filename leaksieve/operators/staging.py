"""Tables written once and read by several reports, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process for applications that name none, by application id.
_own: dict[str, str] = {}


#: Folders written by this process, by application id.
_made: dict[str, list[str]] = {}


def new_folder(spark: SparkSession) -> str:
    """A path of its own below spark.checkpoint.dir (below a new temporary folder where that is unset, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _own[app] = base
    path = f"{base.rstrip('/')}/kept-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete what this process has staged for the application, once nothing reads it any more; returns the number of folders."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        inner = spark._jvm.org.apache.hadoop.fs.Path(path)
        inner.getFileSystem(spark._jsc.hadoopConfiguration()).delete(inner, True)
    return len(paths)


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet in a new folder and read back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
