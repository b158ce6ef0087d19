"""Gapless numbers over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, outer: str, inner: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with a gapless number in the order of (outer, inner).

    Rows are numbered among those of their ``outer`` value and shifted by how many come before, which takes one count per
    distinct value; so no task sees more than the rows of one value, or one row per value.
    """
    counts = df.groupBy(F.col(outer).alias("_outer")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_outer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_outer", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(outer).orderBy(*inner))
    rows = df.withColumn("_inside", inside).join(shifts, F.col(outer).eqNullSafe(F.col("_outer")))
    return rows.withColumn(name, (F.col("_inside") + F.col("_before") + (start - 1)).cast("long")).drop("_outer", "_before", "_inside")
