"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard depends on the key and the shard count alone; there is no ring table, and one more shard takes only the
rows that move into it. Slots inside the shards are numbered without putting a shard in one task: the small rows are
range-partitioned by (shard, key), numbered inside each partition, written, and shifted by the rows that the partitions
before hold of the same shard, a table of at most (partitions + shards) rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm.staging import stage

#: Fixed values of the published algorithm: its linear congruential step.
STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards 0 to ``shards`` - 1 of unsigned 64-bit keys."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(key), np.int64)
    rows = np.arange(len(key))
    nxt = np.zeros(len(key), np.int64)
    while len(rows):
        bucket[rows] = nxt[rows]
        step = key[rows] * STEP + np.uint64(1)
        key[rows] = step
        jump = (nxt[rows] + 1).astype(np.float64) * (float(1 << 31) / ((step >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        nxt[rows] = jump.astype(np.int64)
        rows = rows[nxt[rows] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key; null keys count as 0."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return shard(F.coalesce(key, F.lit(0).cast("long")))


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, size, text_crc32, law ('key'), shard, slot, grown_shard for every row.

    Integer identifiers are the keys themselves, others are hashed first (xxhash64). Rows with equal identifiers share
    a shard; a null identifier counts as key 0. ``size`` is the UTF-8 length plus 1, so a null or empty text has 1.
    Slots count from 0 without gaps in each shard, in order of the identifier, then of checksum and size.
    """
    integer = df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    key = df[id_col].cast("long") if integer else F.xxhash64(df[id_col])
    text = F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary")
    rows = df.select(df[id_col].alias("row_id"), key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("key"), shards)).withColumn("grown_shard", shard_of(F.col("key"), shards + 1))
    order = ["shard", "row_id", "text_crc32", "size"]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stage(numbered.drop("key").withColumn("part", F.shiftright("at", 33)), "shards")
    runs = placed.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(runs.select("shard", "part", (before - F.col("first")).alias("shift")))
    return placed.join(shift, ["shard", "part"]).select("row_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot"), "grown_shard")


#: Shards of the query.
SHARDS = 8


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_rows(docs, SHARDS).withColumnRenamed("row_id", "doc_id")
