"""Rebalanced baskets: selection dates, turnover and compounded returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def every_nth(df: DataFrame, by: list[str], day: str, n: int) -> DataFrame:
    """The rows of each group's 1st, (n + 1)th, ... distinct day."""
    days = df.select(*by, day).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy(day)) - 1
    return df.join(days.withColumn("_place", place).filter(F.col("_place") % n == 0).drop("_place"), [*by, day], "left_semi")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def turnover(now: Column, before: Column, k: int) -> Column:
    """Members that left or joined, over twice the basket's size; no basket before counts as an empty one."""
    before = F.coalesce(before, F.array().cast("array<string>"))
    moved = F.size(F.array_except(now, before)) + F.size(F.array_except(before, now))
    return moved.cast("double") / F.lit(2.0 * k)


def compounded(ret: Column, window) -> Column:
    """(1 + r1)(1 + r2)... - 1 up to each row, multiplied in order; ``window`` is ordered, from the first row to this."""
    return F.product(1 + ret).over(window) - 1
