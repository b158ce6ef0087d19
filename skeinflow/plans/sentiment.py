"""Daily sentiment of scored articles, dense and sparse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.exact import mean, sd_sample
from skeinflow.functions.keys import name_key
from skeinflow.operators.numbering import number_rows

#: Units of a scored probability and of a daily mean.
MILLI, MICRO = 1000, 1e6
DAY = ["symbol", "trade_date"]


def _micro(c):
    return F.round(c * F.lit(MICRO)).cast("long")


def news_daily(scored: DataFrame) -> DataFrame:
    """Means, sample deviation and number of a day's news, in whole millionths."""
    rows = scored.filter("kind = 'news' AND trade_date IS NOT NULL").groupBy(*DAY)
    return rows.agg(*[_micro(mean(F.col(c), MILLI)).alias(f"news_{c}") for c in ("pos", "neu", "neg", "score")], _micro(sd_sample(F.col("score"), MILLI)).alias("news_disp"), F.count("*").alias("n_news"))


def press_daily(scored: DataFrame) -> DataFrame:
    rows = scored.filter("kind = 'press' AND trade_date IS NOT NULL").groupBy(*DAY)
    return rows.agg(*[_micro(mean(F.col(c), MILLI)).alias(f"press_{c}") for c in ("pos", "neu", "neg", "score")], F.count("*").alias("n_press"))


def filings_daily(scored: DataFrame) -> DataFrame:
    return scored.filter("kind = '8K' AND trade_date IS NOT NULL").groupBy(*DAY).agg(F.countDistinct("accession").alias("n_8k"))


def full_outer(news: DataFrame, press: DataFrame) -> DataFrame:
    """Days with news or press, as they come."""
    ones = lambda c: (F.col(c).cast("double") / F.lit(MICRO))
    both = news.select(*DAY, ones("news_score").alias("news_score"), "n_news").join(press.select(*DAY, ones("press_score").alias("press_score"), "n_press"), DAY, "full_outer")
    return both.select(*DAY, "news_score", "n_news", "press_score", "n_press")


def sentiment_grid(calendar: DataFrame, companies: DataFrame, news: DataFrame, press: DataFrame, filings: DataFrame) -> DataFrame:
    """A row per trading day and company: rolling means over 3 and 30 rows of the grid, volumes and changes.

    A day without news counts as neutral and, like a mean of exactly zero (one, for neutral), is left out of the rolling
    means; results without any are 0. The grid is bounded by the calendar times the universe.
    """
    days = calendar.filter("is_trading_day").select("date_key", F.col("full_date").alias("trade_date"))
    grid = companies.select("company_key", "symbol").crossJoin(F.broadcast(days))
    rows = grid.join(news, DAY, "left").join(press, DAY, "left").join(filings, DAY, "left")
    fill = {"news_pos": 0, "news_neu": int(MICRO), "news_neg": 0, "news_score": 0, "news_disp": 0, "n_news": 0, "press_score": 0, "n_8k": 0}
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v).cast("long")) for c, v in fill.items()})
    by = Window.partitionBy("company_key").orderBy("trade_date")
    w3, w30 = by.rowsBetween(-2, 0), by.rowsBetween(-29, 0)
    rolling = lambda c, w: F.coalesce(mean(F.nullif(F.col(c), F.lit(0).cast("long")), MICRO, w), F.lit(0.0))
    change = F.col("news_score") - F.lag("news_score", 5).over(by)
    facts = rows.select(
        "date_key", "company_key",
        rolling("news_score", w3).alias("finbert_news_mean_3d"), rolling("news_score", w30).alias("finbert_news_mean_30d"), rolling("press_score", w30).alias("finbert_press_30d"),
        F.sum("n_news").over(w3).alias("n_news_3d"), F.sum("n_8k").over(w30).alias("n_8k_30d"),
        rolling("news_pos", w3).alias("finbert_news_pos_3d"), rolling("news_neg", w3).alias("finbert_news_neg_3d"), rolling("news_pos", w30).alias("finbert_news_pos_30d"), rolling("news_neg", w30).alias("finbert_news_neg_30d"),
        F.coalesce(change.cast("double") / F.lit(MICRO), F.lit(0.0)).alias("news_mean_change_5d"), rolling("news_disp", w3).alias("news_disp_3d"), F.col("trade_date").alias("as_of_date"),
    )
    return number_rows(facts, "as_of_date", ["company_key"], "fact_sentiment_key", 1001)


def with_company_key(df: DataFrame) -> DataFrame:
    return df.withColumn("company_key", name_key(F.col("symbol")))
