"""Cleaned prices with technical features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.exact import mean, sd_population, units
from skeinflow.functions.keys import date_key, name_key, pair_key

#: Units of a price and of a return.
CENTS, NANOS = 100, 1e9
#: Trading days of a year.
YEAR = 252.0
PX = ["open_px", "high_px", "low_px", "close_px"]


def typed_prices(raw: DataFrame) -> DataFrame:
    """Prices landed as text, typed: blank and unreadable numbers become null, rows without a readable day or close go."""
    number = lambda c: F.expr(f"try_cast(nullif(trim({c}), '') AS decimal(18,6))").cast("double").alias(f"{c}_px")
    typed = raw.filter("close IS NOT NULL AND close <> ''").select("symbol", F.expr("try_cast(trade_date AS date)").alias("trade_date"), *[number(c) for c in ("open", "high", "low", "close")], F.expr("try_cast(nullif(trim(volume), '') AS bigint)").alias("volume"))
    return typed.filter("trade_date IS NOT NULL AND close_px IS NOT NULL")


def price_features(bars: DataFrame, digits: int = 6) -> DataFrame:
    """One row per bar: keys, prices, returns, moving averages, band position and volatility; partial frames count.

    All windows share one partitioning and one order, so the bars are exchanged and sorted once. Averages and deviations
    are exact in cents and billionths. ema_12 and ema_26 are plain means, macd_hist their difference, rsi_14 is left to a
    later step and null, vol_20d is annualised.
    """
    by = Window.partitionBy("symbol").orderBy("trade_date")
    last = lambda n: by.rowsBetween(1 - n, 0)
    before = F.lag("close_px").over(by)
    ret = F.when((before > 0) & (F.col("close_px") > 0), F.log(F.col("close_px") / before))
    rows = bars.withColumn("c", units(F.col("close_px"), CENTS)).withColumn("log_ret", ret).withColumn("r", units(F.col("log_ret"), NANOS))
    averages = {f"sma_{n}": mean(F.col("c"), CENTS, last(n)) for n in (5, 20, 50)} | {f"ema_{n}": mean(F.col("c"), CENTS, last(n)) for n in (12, 26)}
    rows = rows.withColumns(averages | {"sd_close": sd_population(F.col("c"), CENTS, last(20)), "sd_ret": sd_population(F.col("r"), NANOS, last(20))})
    band = F.when(F.col("sd_close") > 0, (F.col("close_px") - F.col("sma_20")) / F.col("sd_close")).otherwise(0.0)
    day = F.col("trade_date")
    return rows.select(
        pair_key(F.col("symbol"), day).alias("price_key"), date_key(day).alias("date_key"), name_key(F.col("symbol")).alias("company_key"), "symbol", "trade_date", *PX, "volume",
        F.round("log_ret", digits).alias("log_ret_1d"), "sma_5", "sma_20", "sma_50", "ema_12", "ema_26", (F.col("ema_12") - F.col("ema_26")).alias("macd_hist"),
        F.round(band, digits).alias("bb_z"), F.lit(None).cast("double").alias("rsi_14"), F.round(F.col("sd_ret") * F.sqrt(F.lit(YEAR)), digits).alias("vol_20d"), day.alias("as_of_date"),
    )
