"""The daily feature panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.operators.asof import asof_join
from skeinflow.operators.numbering import number_rows

#: The features' names by group.
PRICE_FEATURES = ["log_ret_1d", "sma_5", "sma_20", "sma_50", "ema_12", "ema_26", "rsi_14", "macd_hist", "bb_z", "vol_20d"]
RATIOS = ["roe", "roa", "debt_eq", "gross_margin", "op_margin", "asset_turnover"]
PROXIES = ["pe_ttm_proxy", "pb_proxy", "ebitda_to_ev_proxy", "fcf_to_assets"]
SENTIMENT = ["finbert_news_mean_3d", "finbert_news_mean_30d", "finbert_press_30d", "n_news_3d", "n_8k_30d", "finbert_news_pos_3d", "finbert_news_neg_3d", "finbert_news_pos_30d", "finbert_news_neg_30d", "news_mean_change_5d", "news_disp_3d"]
PCS = [f"filing_pc{i}" for i in range(1, 6)]
CROSSES = ["senti_x_vol", "senti_x_absret", "newsvol_x_vol"]
#: Rows ahead of the target.
AHEAD = 5


def sector_flags(companies: DataFrame, sectors: list[str]) -> DataFrame:
    return companies.select("*", *[F.when(F.col("sector_name") == s, 1).otherwise(0).cast("long").alias(f"is_{s.lower().replace(' ', '_')}") for s in sectors])


def feature_panel(prices: DataFrame, fundamentals: DataFrame, sentiment: DataFrame, pcs: DataFrame | None, companies: DataFrame, sectors: list[str], tail: str = "zero", bucket: Column | None = None) -> DataFrame:
    """One row per bar with all features, the target and the latest date of what it is made of.

    ``tail`` decides the label of the last AHEAD bars of a company: "zero" or "null". Without ``pcs`` their columns are 0. ``bucket`` splits long series in the as-of joins.
    """
    used = ["net_income_ttm", "total_equity", "ebitda_ttm", "total_assets", "cash", "total_debt", "free_cash_flow_ttm", *RATIOS]
    target = F.lead("close_px", AHEAD).over(Window.partitionBy("symbol").orderBy("trade_date"))
    rows = asof_join(prices.withColumn("ahead", target), fundamentals, ["symbol"], "trade_date", "filing_date", used, bucket=bucket)
    if pcs is None:
        rows = rows.withColumns({c: F.lit(0.0) for c in PCS}).withColumn("pc_date", F.lit(None).cast("date"))
    else:
        rows = asof_join(rows, pcs.withColumnRenamed("as_of_date", "pc_date"), ["symbol"], "trade_date", "pc_date", PCS, bucket=bucket)
    flags = sector_flags(companies, sectors)
    own = [c for c in flags.columns if c.startswith("is_")]
    rows = rows.join(flags.select("company_key", "sector_key", *own), "company_key")
    rows = rows.join(sentiment.select("date_key", "company_key", *SENTIMENT, F.col("as_of_date").alias("s_date")), ["date_key", "company_key"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long") if c.startswith("n_") else F.lit(0.0)) for c in SENTIMENT} | {c: F.coalesce(c, F.lit(0.0)) for c in PCS}
    rows = rows.withColumns(zero)
    close, col = F.col("close_px"), F.col
    ev = col("total_assets") - col("cash") + col("total_debt")
    label = F.when(col("ahead") > close, 1).otherwise(0)
    if tail == "null":
        label = F.when(col("ahead").isNotNull(), label)
    news = col("finbert_news_mean_3d")
    rows = rows.withColumns({
        "pe_ttm_proxy": F.when((col("net_income_ttm") > 0) & (close > 0), close / col("net_income_ttm") * 1e9),
        "pb_proxy": F.when((col("total_equity") > 0) & (close > 0), close / (col("total_equity") / 1e9)),
        "ebitda_to_ev_proxy": F.when((col("ebitda_ttm") > 0) & (col("total_assets") > 0) & (ev != 0), col("ebitda_ttm") / ev),
        "fcf_to_assets": F.when(col("total_assets") > 0, col("free_cash_flow_ttm") / col("total_assets")),
        "senti_x_vol": col("vol_20d") * news, "senti_x_absret": F.abs("log_ret_1d") * news, "newsvol_x_vol": col("n_news_3d").cast("double") * col("vol_20d"),
        "y_5d_up": label.cast("long"),
        "as_of_date": F.greatest("as_of_date", F.coalesce("filing_date", "as_of_date"), F.coalesce("s_date", "as_of_date"), F.coalesce("pc_date", "as_of_date")),
    })
    rows = rows.filter("log_ret_1d IS NOT NULL AND sma_50 IS NOT NULL")
    rows = rows.select("price_key", "date_key", "company_key", "sector_key", "symbol", "trade_date", "close_px", *PRICE_FEATURES, *RATIOS, *PROXIES, *SENTIMENT, *own, *CROSSES, *PCS, "y_5d_up", "as_of_date")
    return number_rows(rows, "trade_date", ["company_key"], "fact_panel_key", 1001)


def feature_panel_b(prices: DataFrame, fundamentals: DataFrame, daily: DataFrame, pcs: DataFrame, companies: DataFrame) -> DataFrame:
    """The streaming variant: a continuous target, null where the bars end, sparse daily sentiment, no imputation."""
    ahead = F.lead("close_px", AHEAD).over(Window.partitionBy("symbol").orderBy("trade_date"))
    # the bucketed strategy: a long series spreads over years
    year = F.year("_at")
    rows = asof_join(prices.withColumn("ahead", ahead), fundamentals, ["symbol"], "trade_date", "filing_date", RATIOS, bucket=year)
    rows = asof_join(rows, pcs.withColumnRenamed("as_of_date", "pc_date"), ["symbol"], "trade_date", "pc_date", PCS, bucket=year)
    rows = rows.join(companies.select("company_key"), "company_key", "left_semi").join(daily, ["symbol", "trade_date"], "left")
    known = F.col("ahead").isNotNull() & (F.col("close_px") > 0)
    features = [c for c in PRICE_FEATURES if c != "rsi_14"]
    return rows.select(
        "price_key", "date_key", "company_key", "symbol", "trade_date", *features, *RATIOS, F.round(F.when(known, F.log(F.col("ahead") / F.col("close_px"))), 6).alias("y_5d_logret"),
        F.when(known, F.when(F.col("ahead") > F.col("close_px"), 1).otherwise(0)).cast("long").alias("y_5d_up"), "news_score", "n_news", "press_score", "n_press", *PCS,
    )


def leaks(panel: DataFrame) -> DataFrame:
    """Number of rows that know something later than their day."""
    return panel.agg(F.count("*").alias("n_rows"), F.count_if(F.col("as_of_date") > F.col("trade_date")).alias("n_leaks"))
