"""Predictions, their evaluation, and the backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.keys import date_key
from skeinflow.operators.baskets import compounded, every_nth, top_k, turnover
from skeinflow.operators.metrics import auc, signed_rank_test, wilcoxon
from skeinflow.sources.versions import VersionedTable

#: Names of a basket, days between rebalances, cost of a full turnover in basis points.
TOP, EVERY, COST = 5, 5, 5
DIGITS = 6


#: The stand-in's weights for each rung.
LOGIT = {0: {"log_ret_1d": 0.5}, 1: {"bb_z": -0.3, "log_ret_1d": 0.2}, 2: {"bb_z": -0.3, "finbert_news_mean_3d": 2.0, "vol_20d": 0.01}}


def logistic_predictions(panel: DataFrame, attributions: bool = False) -> DataFrame:
    """A deterministic stand-in for fitted models: date_key, company_key, symbol, trade_date, model_rung, prob_up, predicted_class, y_5d_up.

    With ``attributions`` also their JSON: the terms whose sum is the prediction's logit, by feature.
    """

    def rung(number: int, weights: dict[str, float]) -> Column:
        terms = {name: F.col(name) * F.lit(w) for name, w in weights.items()}
        z = None
        for term in terms.values():
            z = term if z is None else z + term
        told = [F.to_json(F.create_map(*[x for name, term in terms.items() for x in (F.lit(name), term)])).alias("attributions")] if attributions else []
        return F.struct(F.lit(number).cast("long").alias("model_rung"), z.alias("z"), *told)

    rungs = F.explode(F.array(*[rung(n, w) for n, w in LOGIT.items()]))
    rows = panel.select("date_key", "company_key", "symbol", "trade_date", "y_5d_up", rungs.alias("m")).select("*", "m.model_rung", F.round(1 / (1 + F.exp(-F.col("m.z"))), 5).alias("prob_up"))
    more = [F.col("m.attributions").alias("attributions")] if attributions else []
    return rows.select("date_key", "company_key", "symbol", "trade_date", "model_rung", "prob_up", (F.col("prob_up") > 0.5).cast("long").alias("predicted_class"), "y_5d_up", *more)


def fold_auc(assigned: DataFrame) -> DataFrame:
    return auc(assigned, ["model_rung", "fold_id"], "prob_up", "y_5d_up")


def fold_accuracy(assigned: DataFrame) -> DataFrame:
    right = F.sum((F.col("predicted_class") == F.col("y_5d_up")).cast("long"))
    return assigned.groupBy("model_rung", "fold_id").agg(F.count("*").alias("n"), (right.cast("double") / F.count("*").cast("double")).alias("accuracy"))


def rung_test(aucs: DataFrame, first: int = 1, second: int = 2) -> DataFrame:
    """The signed-rank test of two rungs' AUCs on their common folds."""
    a, b = (aucs.filter(F.col("model_rung") == r).select("fold_id", F.col("auc").alias(f"auc_{r}")) for r in (first, second))
    return wilcoxon(a.join(b, "fold_id").withColumn("d", F.round(F.col(f"auc_{second}") - F.col(f"auc_{first}"), 9)), "d")


PREDICTIONS = "date_key string, company_key string, trade_date date, model_rung long, fold_id string, prob_up double, predicted_class long, attributions string"


def keep_predictions(df: DataFrame, path: str) -> DataFrame:
    """Replaces the rungs that ``df`` holds in the committed table of predictions and returns the table.

    Readers see a rung's old predictions or all of its new ones; of two runs of one rung at a time the second fails.
    """
    table = VersionedTable(df.sparkSession, path, PREDICTIONS, by="model_rung")
    base = table.state()
    table.replace(df.select("*", *[F.lit(None).alias(n) for n in table.schema.names if n not in df.columns]), base)
    return table.read()


def labelled(predictions: DataFrame, panel: DataFrame) -> DataFrame:
    """Predictions with their symbol and label from the panel."""
    return predictions.drop("symbol", "y_5d_up").join(panel.select("date_key", "company_key", "symbol", "y_5d_up"), ["date_key", "company_key"])


def run_metrics(assigned: DataFrame) -> DataFrame:
    """(model_rung, fold_id, metric, value) of every fold: test_auc (where both labels occur), accuracy, n_test_rows."""
    right, n = F.sum((F.col("predicted_class") == F.col("y_5d_up")).cast("long")), F.count("*")
    plain = assigned.groupBy("model_rung", "fold_id").agg((right.cast("double") / n.cast("double")).alias("accuracy"), n.cast("double").alias("n_test_rows"))
    both = plain.join(fold_auc(assigned).select("model_rung", "fold_id", F.col("auc").alias("test_auc")), ["model_rung", "fold_id"], "left")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("test_auc", "accuracy", "n_test_rows")]))
    return both.select("model_rung", "fold_id", pairs.alias("m")).select("model_rung", "fold_id", "m.*").filter("value IS NOT NULL")


def run_params(models: DataFrame, rung: int, family: str, n_features: int) -> DataFrame:
    """(model_rung, fold_id, metric, value) of the folds' models: features, fitted rows, and each feature's importance."""
    base = models.select(F.lit(rung).cast("long").alias("model_rung"), "fold_id", "n_rows", "importances")
    flat = F.map_concat(F.create_map(F.lit("n_features"), F.lit(float(n_features)), F.lit("n_fit_rows"), F.col("n_rows").cast("double")), F.map_from_entries(F.transform(F.map_entries("importances"), lambda e: F.struct(F.concat(F.lit("fi_"), e["key"]).alias("key"), e["value"].alias("value")))))
    return base.select("model_rung", "fold_id", F.explode(flat).alias("metric", "value")).withColumn("family", F.lit(family)).select("model_rung", "fold_id", "family", "metric", "value")


def rung_chance(aucs: DataFrame, first: int = 1, second: int = 2) -> DataFrame:
    """The signed-rank test of two rungs with its p-value; fewer than three common folds give no rows."""
    a, b = (aucs.filter(F.col("model_rung") == r).select("fold_id", F.col("auc").alias(name)) for r, name in ((first, "one"), (second, "two")))
    return signed_rank_test(a.join(b, "fold_id").withColumn("d", F.round(F.col("two") - F.col("one"), 9)), "d")


def drive_rung(panel: DataFrame, folds: DataFrame, features: list[str], rung: int, use, path: str, against: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fits and predicts all folds of a rung, keeps its predictions at ``path`` in place of earlier ones, and returns (the
    table of predictions, the rungs' fold metrics, the signed-rank test against rung ``against``: no rows without it)."""
    from skeinflow.ml import trees

    kept = keep_predictions(trees.walk_forward(panel, folds, features, rung, use), path)
    rows = labelled(kept, panel)
    return kept, run_metrics(rows), rung_chance(fold_auc(rows), against, rung)


def forward_returns(prices: DataFrame, ahead: int = 5) -> DataFrame:
    later = F.lead("close_px", ahead).over(Window.partitionBy("company_key").orderBy("trade_date"))
    return prices.select("company_key", "trade_date", F.when(F.col("close_px") > 0, (later - F.col("close_px")) / F.col("close_px")).alias("fwd_ret"))


def backtest(predictions: DataFrame, prices: DataFrame) -> DataFrame:
    """model_rung, trade_date, n_long, gross_ret, tx_cost, net_ret, cum_net_ret: the top names of every EVERYth day.

    A day on which no chosen name has a return is skipped before the previous basket is looked up. Equal probabilities
    go to the smaller key. Returns are averaged in billionths.
    """
    chosen = top_k(every_nth(predictions, ["model_rung"], "trade_date", EVERY), ["model_rung", "trade_date"], [F.desc("prob_up"), F.col("company_key")], TOP)
    rows = chosen.join(forward_returns(prices), ["company_key", "trade_date"], "left").withColumn("r", F.round(F.col("fwd_ret") * 1e9).cast("long"))
    days = rows.groupBy("model_rung", "trade_date").agg(F.count("r").alias("n_long"), F.sum("r").alias("total"), F.array_sort(F.collect_set("company_key")).alias("basket")).filter("n_long > 0")
    by = Window.partitionBy("model_rung").orderBy("trade_date")
    gross = F.col("total").cast("double") / F.col("n_long").cast("double") / F.lit(1e9)
    cost = turnover(F.col("basket"), F.lag("basket").over(by), TOP) * (COST / 10000.0)
    net = days.withColumns({"gross": gross, "tx_cost": cost}).withColumn("net", F.col("gross") - F.col("tx_cost"))
    cum = compounded(F.col("net"), by.rowsBetween(Window.unboundedPreceding, 0))
    return net.select("model_rung", "trade_date", "n_long", F.round("gross", DIGITS).alias("gross_ret"), F.round("tx_cost", DIGITS).alias("tx_cost"), F.round("net", DIGITS).alias("net_ret"), F.round(cum, DIGITS).alias("cum_net_ret"))


def backtest_log(panel: DataFrame, predictions: DataFrame) -> DataFrame:
    """The streaming variant: rows without a target go first, the basket's mean log return less its cost."""
    rows = predictions.join(panel.select("date_key", "company_key", "y_5d_logret"), ["date_key", "company_key"]).filter("y_5d_logret IS NOT NULL")
    chosen = top_k(every_nth(rows, ["model_rung"], "trade_date", EVERY), ["model_rung", "trade_date"], [F.desc("prob_up"), F.col("symbol")], TOP)
    micro = F.round(F.col("y_5d_logret") * 1e6).cast("long")
    days = chosen.groupBy("model_rung", "trade_date").agg((F.sum(micro).cast("double") / F.count("*").cast("double") / F.lit(1e6)).alias("ret"), F.array_sort(F.collect_set("symbol")).alias("basket"))
    by = Window.partitionBy("model_rung").orderBy("trade_date")
    cost = turnover(F.col("basket"), F.lag("basket").over(by), TOP) * (COST / 10000.0)
    return days.select("model_rung", "trade_date", F.round(F.col("ret") - cost, DIGITS).alias("net_ret"))


def benchmark(prices: DataFrame, pnl: DataFrame) -> DataFrame:
    """trade_date, benchmark_cum: the universe's equal-weight daily return, compounded from ``pnl``'s first day to its last.

    One row per day, so the compounding window is small.
    """
    before = F.lag("close_px").over(Window.partitionBy("symbol").orderBy("trade_date"))
    ret = prices.select("trade_date", F.when(before > 0, F.round((F.col("close_px") - before) / before * 1e9).cast("long")).alias("r")).filter("r IS NOT NULL")
    days = ret.groupBy("trade_date").agg((F.sum("r").cast("double") / F.count("r").cast("double") / F.lit(1e9)).alias("day"))
    span = pnl.agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))  # one row
    days = days.crossJoin(F.broadcast(span)).filter(F.col("trade_date").between(F.col("first"), F.col("last")))
    cum = compounded(F.col("day"), Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    return days.select("trade_date", F.round(cum, DIGITS).alias("benchmark_cum"))


def with_benchmark(pnl: DataFrame, bench: DataFrame) -> DataFrame:
    return pnl.join(bench, "trade_date", "left").select(date_key(F.col("trade_date")).alias("date_key"), *pnl.columns, "benchmark_cum")


def summary(pnl: DataFrame) -> DataFrame:
    """model_rung, n_periods, final_cum, ann_ret_pct, sharpe (null for one period), annualised by EVERY."""
    year = 252.0 / EVERY
    micro = F.round(F.col("net_ret") * 1e6).cast("decimal(18,0)")
    n, s1, s2 = F.count("*"), F.sum(micro), F.sum(micro * micro)
    rows = pnl.groupBy("model_rung").agg(F.countDistinct("trade_date").alias("n_periods"), F.max_by("cum_net_ret", "trade_date").alias("final_cum"), n.alias("n"), s1.cast("double").alias("s1"), (n.cast("decimal(10,0)") * s2.cast("decimal(27,0)") - s1.cast("decimal(19,0)") * s1.cast("decimal(19,0)")).cast("double").alias("spread"))
    mean = F.col("s1") / F.col("n").cast("double") / 1e6
    sd = F.sqrt(F.col("spread") / (F.col("n").cast("double") * (F.col("n") - 1).cast("double"))) / 1e6
    sharpe = F.when(F.col("n") > 1, mean / F.greatest(sd, F.lit(1e-9)) * F.sqrt(F.lit(year)))
    return rows.select("model_rung", "n_periods", "final_cum", F.round(mean * year * 100, 4).alias("ann_ret_pct"), F.round(sharpe, 4).alias("sharpe"))
