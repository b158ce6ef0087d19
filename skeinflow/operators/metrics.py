"""Ranking metrics in DataFrames."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mid_rank(over: list[str], value: Column) -> Column:
    """Rank from 1, ties sharing the mean of their places."""
    window = Window.partitionBy(*over)
    return F.rank().over(window.orderBy(value)).cast("double") + (F.count("*").over(Window.partitionBy(*over, value)).cast("double") - 1) / 2


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """(by, n, n_pos, auc) of the groups with both labels, from counts per distinct score.

    Rows with the same score are counted before anything is ranked, so the windows run over distinct scores.
    """
    counts = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(label).alias("n"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    # twice the number of (positive, lower negative) pairs plus the tied ones stays whole
    neg = F.col("n") - F.col("pos")
    pairs = F.col("pos") * (2 * F.coalesce(F.sum(neg).over(below), F.lit(0)) + neg)
    out = counts.withColumn("pairs", pairs).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum("pairs").alias("pairs"))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return out.filter(both).select(*by, "n", "n_pos", (F.col("pairs").cast("double") / (2 * F.col("n_pos") * (F.col("n") - F.col("n_pos"))).cast("double")).alias("auc"))


def wilcoxon(df: DataFrame, difference: str) -> DataFrame:
    """One row (n, w_plus, w_minus, statistic) of the signed-rank test; zero differences are left out, ties share ranks.

    The input is one row per fold, so a single window is enough.
    """
    d = df.filter(F.col(difference) != 0).select(F.col(difference).alias("d"), F.round(F.abs(difference), 9).alias("size"))
    ranked = d.withColumn("r", mid_rank([], F.col("size")))
    plus, minus = F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0))
    out = ranked.agg(F.count("*").alias("n"), F.coalesce(plus, F.lit(0.0)).alias("w_plus"), F.coalesce(minus, F.lit(0.0)).alias("w_minus"))
    return out.withColumn("statistic", F.least("w_plus", "w_minus"))


#: Pairs up to which the signed-rank test's chance is counted exactly, if no sizes tie.
EXACT = 50


def signed_rank_chance(n: int, statistic: float, sizes: list[int]) -> float | None:
    """The two-sided chance of a signed-rank statistic of ``n`` differences; ``sizes`` are the numbers of equal ones.

    Without ties and up to EXACT pairs all 2^n signs are counted, else the normal law is used, its variance less the
    ties' share. None for no differences.
    """
    if not n:
        return None
    if n <= EXACT and all(s == 1 for s in sizes):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for total in range(len(ways) - 1, rank - 1, -1):
                ways[total] += ways[total - rank]
        return min(1.0, 2 * sum(ways[: int(statistic) + 1]) / 2**n)
    mean = n * (n + 1) / 4
    spread = n * (n + 1) * (2 * n + 1) / 24 - sum(s**3 - s for s in sizes) / 48
    return math.erfc(abs(statistic - mean) / math.sqrt(spread) / math.sqrt(2)) if spread > 0 else 1.0


def signed_rank_test(df: DataFrame, difference: str, least: int = 3) -> DataFrame:
    """``wilcoxon`` with mean_difference, n_pairs and p_value (six digits); fewer than ``least`` pairs give no rows.

    The input is one row per fold, so its few rows make one array.
    """

    @F.arrow_udf("double", F.ArrowUDFType.SCALAR)
    def chance(n: pa.Array, statistic: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array([signed_rank_chance(*row) for row in zip(n.to_pylist(), statistic.to_pylist(), sizes.to_pylist(), strict=True)], pa.float64())

    known = df.filter(F.col(difference).isNotNull())
    sizes = known.filter(F.col(difference) != 0).groupBy(F.round(F.abs(difference), 9).alias("size")).agg(F.count("*").alias("c")).agg(F.coalesce(F.collect_list("c"), F.array().cast("array<bigint>")).alias("sizes"))
    pairs = known.agg(F.count("*").alias("n_pairs"), F.round(F.avg(difference), 9).alias("mean_difference")).filter(F.col("n_pairs") >= least)
    rows = wilcoxon(known, difference).crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(pairs))  # one row each
    return rows.withColumn("p_value", F.round(chance("n", "statistic", "sizes"), 6)).drop("sizes")


def reciprocal_rank(hits: DataFrame, by: str, rank: str, hit: str, k: int) -> DataFrame:
    """(by, rr, precision, n_hits) of ranked results: the reciprocal of the first hit's rank, and hits over k."""
    first, n = F.min(F.when(F.col(hit), F.col(rank))), F.count_if(F.col(hit))
    rr = F.coalesce(F.lit(1.0) / first.cast("double"), F.lit(0.0))
    return hits.filter(F.col(rank) <= k).groupBy(by).agg(rr.alias("rr"), (n.cast("double") / k).alias("precision"), n.alias("n_hits"))
