"""Scored articles: incremental, stratified, and keyed by company and day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.keys import name_key
from skeinflow.ml.sentiment import FittedSentiment
from skeinflow.operators.upsert import upsert_columns
from skeinflow.sources.landing import new_rows, stratified

SCORES = ["pos_prob", "neu_prob", "neg_prob", "score"]


def score_articles(df: DataFrame, key: str, body: str, sentiment: Callable[[Column], Column] | FittedSentiment) -> DataFrame:
    """(key, symbol, company_key, published_at, trade_date, scores) of articles (key, symbol, published_at as text, body).

    An unreadable time leaves the day null. ``sentiment`` is a fitted scorer, or makes the scores of a text's column.
    """
    named = df.select(key, "symbol", name_key(F.col("symbol")).alias("company_key"), "published_at", F.expr("to_date(try_to_timestamp(published_at))").alias("trade_date"), F.col(body).alias("_body"))
    rows = sentiment.scored(named, "_body") if isinstance(sentiment, FittedSentiment) else named.withColumn("s", sentiment(F.col("_body")))
    return rows.select(key, "symbol", "company_key", "published_at", "trade_date", "s.*")


def score_new(df: DataFrame, done: DataFrame, key: str, body: str, sentiment: Callable[[Column], Column] | FittedSentiment, per_stratum: int | None = None) -> DataFrame:
    """Scores of the articles that ``done`` lacks; with ``per_stratum`` at most so many per symbol and quarter."""
    todo = new_rows(df, done, [key])
    if per_stratum is not None:
        quarter = F.expr("date_trunc('quarter', try_to_timestamp(published_at))")
        todo = stratified(todo.withColumn("_quarter", quarter).filter("published_at IS NOT NULL"), ["symbol", "_quarter"], key, per_stratum).drop("_quarter", "place")
    return score_articles(todo, key, body, sentiment)


def merge_scores(done: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The scored table after ``new``: articles that are there change in their scores only."""
    return upsert_columns(done, new, [key], SCORES)
