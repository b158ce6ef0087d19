"""Statements joined, summed over four quarters, and their ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.keys import name_key, pair_key

KEY = ["symbol", "filing_date"]
FLOWS = ["revenue", "gross_profit", "operating_income", "net_income", "ebitda", "free_cash_flow", "operating_cash_flow"]
LEVELS = ["total_assets", "total_liabilities", "total_equity", "total_debt", "cash"]
#: Units in which statements are summed.
UNIT = 1e4


def joined_statements(income: DataFrame, balance: DataFrame, flows: DataFrame) -> DataFrame:
    return income.join(balance, KEY, "left").join(flows, KEY, "left")


def trailing(joined: DataFrame) -> DataFrame:
    """Sums of flows and means of assets and equity over this quarter and the three before; early quarters are partial.

    Ratios are null unless their denominator is positive; rows without revenue go.
    """
    year = Window.partitionBy("symbol").orderBy("filing_date").rowsBetween(-3, 0)
    ones = lambda c: c.cast("double") / F.lit(UNIT)
    sums = {f"{c}_ttm": ones(F.sum(c).over(year)) for c in FLOWS}
    means = {f"avg_{n}_ttm": F.when(F.count(c).over(year) > 0, F.sum(c).over(year).cast("double") / F.count(c).over(year).cast("double") / F.lit(UNIT)) for n, c in (("assets", "total_assets"), ("equity", "total_equity"))}
    rows = joined.withColumns(sums | means).withColumns({c: ones(F.col(c)) for c in LEVELS}).filter("revenue_ttm IS NOT NULL")
    ratio = lambda n, d, name: F.when(F.col(d) > 0, F.col(n) / F.col(d)).alias(name)
    return rows.select(
        pair_key(F.col("symbol"), F.col("filing_date")).alias("fund_key"), name_key(F.col("symbol")).alias("company_key"), *KEY, *sums, *means, *LEVELS,
        ratio("net_income_ttm", "avg_equity_ttm", "roe"), ratio("net_income_ttm", "avg_assets_ttm", "roa"), ratio("total_debt", "total_equity", "debt_eq"),
        ratio("gross_profit_ttm", "revenue_ttm", "gross_margin"), ratio("operating_income_ttm", "revenue_ttm", "op_margin"), ratio("revenue_ttm", "avg_assets_ttm", "asset_turnover"),
        F.col("filing_date").alias("as_of_date"),
    )
