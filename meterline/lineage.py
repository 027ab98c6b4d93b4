"""Cutting lineage, and the shared folder it is cut to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_FOLDERS: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir` as the session
    names it. Where it is unset, a local session takes a temporary folder, once for the session;
    any other session is refused, as each executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[key] = tempfile.mkdtemp(prefix="meterline-")
    return _LOCAL_ROOTS[key]


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below `shared_root`."""
    _FOLDERS.append(f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def folders() -> list[str]:
    """The work folders that this process has named so far."""
    return list(_FOLDERS)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete work folders whose rows nothing reads any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        _FOLDERS.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the checkpoint folder: a lost executor costs a re-read, not
    the work so far, and later jobs do not carry the plan that made them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession, "lineage"))
    return df.checkpoint()


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written once as Parquet in the checkpoint folder. For a frame that several
    passes read: each reads only its columns, and the optimizer knows the size."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
