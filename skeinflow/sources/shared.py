"""Tables in the cluster's shared folder.

A stage table cuts lineage: it is a Parquet folder under ``spark.checkpoint.dir``, which the driver and all executors
see, so a lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a local session (tests) keeps stages if the session names no folder.
LOCAL_STAGES = "/tmp/checkpoints"

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only in local sessions that set none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_STAGES


def stage_path(spark: SparkSession, label: str) -> str:
    """A new folder name for a stage; it is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/skeinflow-{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` and returns the table read back: computed once, whatever reads it later."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer."""
    target, system = _hadoop(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _hadoop(spark, path)
    return system.exists(target)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` whose writer has finished."""
    target, system = _hadoop(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []
    return sorted(n for n in names if exists(spark, f"{path}/{n}/_SUCCESS"))


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone before this process is
            return
