"""Expectations and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    """Rows broke an expectation that must hold."""


def keep_valid(df: DataFrame, expectations: dict[str, Column]) -> DataFrame:
    """The rows that meet every expectation; null counts as broken. Works on streams."""
    for condition in expectations.values():
        df = df.filter(F.coalesce(condition, F.lit(False)))
    return df


def violations(df: DataFrame, expectations: dict[str, Column]) -> DataFrame:
    """(expectation, n_rows, n_broken), in one pass."""
    counts = [F.struct(F.lit(name).alias("expectation"), F.count("*").alias("n_rows"), F.count_if(~F.coalesce(c, F.lit(False))).alias("n_broken")) for name, c in expectations.items()]
    return df.agg(F.array(*counts).alias("x")).select(F.inline("x"))


def require(df: DataFrame, expectations: dict[str, Column]) -> DataFrame:
    """``df`` if all rows meet all expectations, else ExpectationError."""
    broken = [f"{r.expectation}: {r.n_broken} of {r.n_rows} rows" for r in violations(df, expectations).collect() if r.n_broken]
    if broken:
        raise ExpectationError("; ".join(broken))
    return df


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("n_broken"))


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that stand more than once."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").agg(F.count("*").alias("n_broken"))


def related(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Non-null values without a parent."""
    return df.filter(F.col(column).isNotNull()).join(parent, df[column] == parent[key], "left_anti").agg(F.count("*").alias("n_broken"))
