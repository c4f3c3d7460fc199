"""Tables in the shared folder of the cluster: cut lineage, survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set, a temporary folder of a one-machine (local) session, and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that materialize() wrote and nobody discarded yet.
_WRITTEN: set[str] = set()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df there as Parquet and read it back. Results read these tables lazily: call clean() once the job's result is stored."""
    path = f"{shared_dir(df.sparkSession)}/ledgerlens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ledgerlens_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.discard(path)


def exists(df: DataFrame) -> bool:
    """Whether what materialize() wrote for df is still there."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._ledgerlens_path)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(path)


def discard(df: DataFrame | None) -> None:
    """Delete what materialize() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_ledgerlens_path", None)
    if path:
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> int:
    """Delete all tables that this process materialized; results that still read them become unreadable."""
    paths = list(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)
