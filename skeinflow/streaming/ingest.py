"""Incremental ingestion with Structured Streaming: file sources and stateless transforms (``keyed`` has tables of changes)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skeinflow.operators.quality import keep_valid
from skeinflow.sources.shared import exists, remove


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", as_text: bool = True, **options: str) -> DataFrame:
    """New files of a folder or glob, all columns as text, with the source's path and the time of ingestion.

    ``kind`` is parquet, json (set multiLine="true" for whole documents) or text (wholetext="true").
    """
    reader = spark.readStream.format(kind).options(**options)
    rows = (reader if kind == "text" else reader.schema(schema)).load(path)
    columns = [F.col(c).cast("string").alias(c) if as_text else F.col(c) for c in rows.columns]
    return rows.select(*columns, F.col("_metadata.file_path").alias("source_path"), F.current_timestamp().alias("ingest_ts"))


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """New files of whole JSON documents, as ``file_stream`` gives them."""
    return file_stream(spark, path, schema, "json", multiLine="true", recursiveFileLookup="true")


def text_documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """symbol, filing_date, body, source_path, ingest_ts of new text files, a file a row; symbol and day are groups 1 and
    2 of ``pattern`` in the path. A path that doesn't match has a blank symbol and no day."""
    rows = file_stream(spark, path, "value string", "text", wholetext="true", recursiveFileLookup="true")
    return rows.select(F.regexp_extract("source_path", pattern, 1).alias("symbol"), F.expr(f"try_to_date(regexp_extract(source_path, r'{pattern}', 2))").alias("filing_date"), F.col("value").alias("body"), "source_path", "ingest_ts")


def watched(stream: DataFrame, expectations: dict[str, Column], name: str) -> DataFrame:
    """The rows that meet every expectation; how many came and broke each is observed under ``name`` as n_rows and the
    expectations' names, so a query's progress tells it."""
    broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(e) for e, c in expectations.items()]
    return keep_valid(stream.observe(name, F.count(F.lit(1)).alias("n_rows"), *broken), expectations)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what is there to a Parquet folder and stops; a second run with the same checkpoint adds new files only."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()


def drain_watched(stream: DataFrame, expectations: dict[str, Column], path: str, checkpoint: str) -> dict[str, int]:
    """``drain`` of the valid rows; returns how many rows came and broke each expectation in this run."""
    rows = watched(stream, expectations, "expectations")
    run = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    run.awaitTermination()
    total = dict.fromkeys(["n_rows", *expectations], 0)
    for progress in run.recentProgress:
        seen = progress.observedMetrics.get("expectations")
        if seen is not None:
            for key in total:
                total[key] += seen[key] or 0
    return total


def full_refresh(spark: SparkSession, *paths: str) -> None:
    """Forgets a stream: its output and its checkpoint."""
    for path in paths:
        remove(spark, path)


def incremental(spark: SparkSession, rows: DataFrame, done_path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies ``work`` to the rows that ``done_path`` lacks, appends the result, and returns everything done."""
    from skeinflow.sources.landing import new_rows

    todo = new_rows(rows, spark.read.parquet(done_path), keys) if exists(spark, f"{done_path}/_SUCCESS") else rows
    work(todo).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)
