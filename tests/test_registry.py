import pytest

from skeinflow.functions.text import lexicon_sentiment
from skeinflow.operators.quality import require
from skeinflow.plans.registry import Registry, market
from skeinflow.plans.scoring import merge_scores, score_articles


def test_order_and_isolation(spark, tmp_path):
    from pyspark.sql import functions as F

    reg = Registry()

    @reg.dataset("raw")
    def a(spark):
        return spark.range(3)

    @reg.dataset("silver", "a")
    def b(spark, a):
        return require(a, {"positive": F.col("id") > 0})

    @reg.dataset("gold", "b", "a")
    def c(spark, b, a):
        return b

    @reg.dataset("gold", "a", view=True)
    def d(spark, a):
        return a.filter("id > 1")

    assert reg.order(["d"]) == ["a", "d"]
    built = reg.build(spark, str(tmp_path))
    assert set(built.tables) == {"a", "d"} and built.tables["d"].count() == 1
    assert "1 of 3" in built.failed["b"] and built.failed["c"] == "left out: b failed"
    with pytest.raises(KeyError):
        reg.order(["nothing"])


def test_market_builds(spark, tmp_path):
    built = market("/root/testdata/sf0.001").build(spark, str(tmp_path))
    assert not built.failed
    panel = built.tables["panel_facts"]
    assert panel.count() > 0 and panel.filter("as_of_date > trade_date").count() == 0


def test_scores_are_merged(spark):
    rows = spark.createDataFrame([("1", "A", "2024-01-02 03:04:05", "gain"), ("2", "B", "never", None)], "id string, symbol string, published_at string, body string")
    first = score_articles(rows, "id", "body", lexicon_sentiment)
    assert [(r.id, str(r.trade_date), r.score) for r in first.orderBy("id").collect()] == [("1", "2024-01-02", 1.0), ("2", "None", 0.0)]
    again = score_articles(rows.selectExpr("id", "'Z' AS symbol", "published_at", "'loss' AS body"), "id", "body", lexicon_sentiment)
    got = merge_scores(first, again, "id").orderBy("id").collect()
    assert [(r.symbol, r.score) for r in got] == [("A", -1.0), ("B", -1.0)]
