"""The datasets behind charts and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.operators.baskets import top_k
from skeinflow.sources.shared import stage


def _latest(predictions: DataFrame, rungs: list[int]) -> DataFrame:
    """Rows of ``rungs`` on the latest day of any of them; the day is one value, so its side is broadcast."""
    mine = predictions.filter(F.col("model_rung").isin(*rungs))
    return mine.join(F.broadcast(mine.agg(F.max("trade_date").alias("trade_date"))), "trade_date")


def cumulative(pnl: DataFrame) -> DataFrame:
    """Cumulative return per rung, the benchmark on the day's first row only."""
    first = F.row_number().over(Window.partitionBy("trade_date").orderBy("model_rung")) == 1
    return pnl.select("trade_date", "model_rung", "cum_net_ret", F.when(first, F.col("benchmark_cum")).alias("benchmark"))


def top5(predictions: DataFrame, companies: DataFrame) -> DataFrame:
    """The five likeliest of each rung on that rung's own latest day."""
    latest = predictions.groupBy("model_rung").agg(F.max("trade_date").alias("trade_date"))
    rows = predictions.join(F.broadcast(latest), ["model_rung", "trade_date"]).join(companies.select("company_key", "sector_name"), "company_key")
    return top_k(rows, ["model_rung"], [F.desc("prob_up"), F.col("symbol")], 5).select("model_rung", "trade_date", "symbol", "sector_name", "prob_up")


def sectors(predictions: DataFrame, companies: DataFrame) -> DataFrame:
    rows = _latest(predictions, [2]).join(companies.select("company_key", "sector_name"), "company_key")
    whole = F.round(F.col("prob_up") * 1e5).cast("long")
    return rows.groupBy("sector_name").agg((F.sum(whole).cast("double") / F.count("*").cast("double") / F.lit(1e5)).alias("avg_prob"), F.count("*").alias("n"))


def distribution(predictions: DataFrame) -> DataFrame:
    """symbol, prob_up, in_top: on the latest day, with those that reach the fifth best value (the least, if fewer)."""
    return _cut_off(_latest(predictions, [2]).select("symbol", "prob_up"))


def _cut_off(rows: DataFrame) -> DataFrame:
    best = rows.agg(F.sort_array(F.collect_list("prob_up"), asc=False).alias("p"))  # one value per company of a day
    cutoff = best.select(F.when(F.size("p") >= 5, F.get("p", F.lit(4))).otherwise(F.array_min("p")).alias("cutoff"))
    return rows.crossJoin(F.broadcast(cutoff)).select("symbol", "prob_up", (F.col("prob_up") >= F.col("cutoff")).alias("in_top"))


def rung_pivot(predictions: DataFrame, n: int = 10) -> DataFrame:
    wide = _latest(predictions, [1, 2]).groupBy("symbol").pivot("model_rung", [1, 2]).agg(F.max("prob_up"))
    wide = wide.select("symbol", F.col("1").alias("rung_1"), F.col("2").alias("rung_2")).withColumn("delta", F.round(F.col("rung_2") - F.col("rung_1"), 5))
    return wide.orderBy(F.desc(F.greatest("rung_1", "rung_2")), "symbol").limit(n)


def lookup(predictions: DataFrame, symbols: DataFrame, day: str) -> DataFrame:
    """symbol, model_rung, prob_up, predicted_class of each symbol on a day: rung 2's, else 1's, else 0's; else 0.5 and 0."""
    rows = predictions.filter(F.col("trade_date") == F.lit(day).cast("date")).groupBy("symbol").agg(F.max_by(F.struct("model_rung", "prob_up", "predicted_class"), "model_rung").alias("p"))
    found = symbols.select("symbol").join(rows, "symbol", "left")
    return found.select("symbol", F.col("p.model_rung").alias("model_rung"), F.coalesce("p.prob_up", F.lit(0.5)).alias("prob_up"), F.coalesce("p.predicted_class", F.lit(0).cast("long")).alias("predicted_class"))


def latest_at_rung(predictions: DataFrame, companies: DataFrame, rung: int = 2) -> DataFrame:
    """All rungs' predictions on the latest day of one of them."""
    day = predictions.filter(F.col("model_rung") == rung).agg(F.max("trade_date").alias("trade_date"))
    return predictions.join(F.broadcast(day), "trade_date").join(companies.select("company_key", "sector_name"), "company_key").select("trade_date", "symbol", "sector_name", "model_rung", "prob_up", "predicted_class")


def companies(dim_company: DataFrame) -> DataFrame:
    """symbol, sector_name of every company, by symbol."""
    return dim_company.select("symbol", "sector_name").orderBy("symbol")


def _of(predictions: DataFrame, symbol: str | DataFrame) -> DataFrame:
    """The predictions of one company, named or in a table of one row (symbol)."""
    if isinstance(symbol, DataFrame):
        return predictions.join(F.broadcast(symbol), "symbol", "left_semi")
    return predictions.filter(F.col("symbol") == symbol)


def days_of(predictions: DataFrame, symbol: str | DataFrame) -> DataFrame:
    """The days on which a company has predictions, latest first."""
    return _of(predictions, symbol).select("trade_date").distinct().orderBy(F.desc("trade_date"))


def predictions_of(predictions: DataFrame, symbol: str | DataFrame, day: str) -> DataFrame:
    """model_rung, prob_up, predicted_class (and attributions, if there) of a company on a day, by rung; no rows if none."""
    rows = _of(predictions.filter(F.col("trade_date") == F.lit(day).cast("date")), symbol)
    return rows.select("model_rung", "prob_up", "predicted_class", *[c for c in ("attributions",) if c in rows.columns]).orderBy("model_rung")


def panels(latest: DataFrame) -> dict[str, DataFrame]:
    """The three panels on the latest frame (``latest_at_rung``): top five per rung, sector means and distribution of rung 2."""
    two = latest.filter("model_rung = 2")
    whole = F.round(F.col("prob_up") * 1e5).cast("long")
    return {
        "top5": top_k(latest, ["model_rung"], [F.desc("prob_up"), F.col("symbol")], 5).select("model_rung", "trade_date", "symbol", "sector_name", "prob_up"),
        "sectors": two.groupBy("sector_name").agg((F.sum(whole).cast("double") / F.count("*").cast("double") / F.lit(1e5)).alias("avg_prob"), F.count("*").alias("n")),
        "distribution": _cut_off(two.select("symbol", "prob_up")),
    }


def datasets(predictions: DataFrame, dim_company: DataFrame, pnl: DataFrame, aucs: DataFrame) -> dict[str, DataFrame]:
    """The datasets of all charts in their order, each computed once; those without rows are left out."""
    made = {
        "cumulative": cumulative(pnl), "top5": top5(predictions, dim_company), "sectors": sectors(predictions, dim_company),
        "distribution": distribution(predictions), "fold_auc": aucs.filter("model_rung IN (1, 2)"), "rung_pivot": rung_pivot(predictions),
    }
    kept = {name: stage(df, name) for name, df in made.items()}
    return {name: df for name, df in kept.items() if not df.isEmpty()}


def decoded(attributions: Column) -> Column:
    """Attributions from JSON to a map; null and unreadable text give null."""
    return F.from_json(attributions, "map<string,double>")


def attribution_top(df: DataFrame, key: str, weights: str, n: int = 10) -> DataFrame:
    """(key, feature, weight, place): the n weights largest by size of a map, in order of their values."""
    entries = F.slice(F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("feature"), e["value"].alias("weight")))), 1, n)
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["weight"].alias("weight"), e["feature"].alias("feature"))))
    return df.select(key, F.posexplode(ordered).alias("place", "e")).select(key, "e.feature", "e.weight", (F.col("place") + 1).cast("long").alias("place"))
