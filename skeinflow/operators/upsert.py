"""Keyed upserts over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], sequence: list[Column | str]) -> DataFrame:
    """One row per key: the one with the greatest ``sequence``.

    A maximum with its row is combined before the shuffle, unlike a row number, so a key that is revised very often costs
    one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """``base`` after ``changes``: the greatest sequence wins; of equal ones the change does."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return last_wins(both, keys, [*sequence, "_new"]).drop("_new")


def upsert_columns(base: DataFrame, changes: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """``base`` after ``changes``, one row per key on each side: existing keys change in ``update`` only, new keys come
    whole. A change's null is a value."""
    c = changes.withColumn("_there", F.lit(True)).alias("c")
    on = None
    for k in keys:
        term = F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
        on = term if on is None else on & term
    there, old = F.col("c._there").isNotNull(), F.col("b._old").isNotNull()
    joined = base.withColumn("_old", F.lit(True)).alias("b").join(c, on, "full_outer")
    pick = lambda col: F.when(there, F.col(f"c.{col}")).otherwise(F.col(f"b.{col}")) if col in update else F.when(old, F.col(f"b.{col}")).otherwise(F.col(f"c.{col}"))
    return joined.select(*[pick(col).alias(col) for col in base.columns])
