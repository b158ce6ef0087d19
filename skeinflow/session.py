"""Session factory and the settings every query of the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results, so every session of the library carries them.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}

#: Bytes of an Arrow batch that goes to Python; one larger row still travels whole.
BATCH_BYTES = 4 << 20


def local_session(app: str = "skeinflow", cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the launcher sets master, memory and partitions."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = SEMANTICS | {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("SKEINFLOW_DRIVER_MEMORY", "8g"),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a directory; opened by Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by bytes, not by their 10,000 rows alone: a worker's memory doesn't grow with its
    partition then. Called where a plan sends texts or vectors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
