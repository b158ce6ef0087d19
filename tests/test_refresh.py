"""Refreshed windowed tables against rebuilding them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinflow.plans.prices import price_features
from skeinflow.streaming.refresh import WindowedTable

SCHEMA = "k string, t int, x long"


def windows(depth, ahead):
    by = Window.partitionBy("k").orderBy("t")

    def make(df):
        past = F.sum("x").over(by.rowsBetween(1 - depth, 0))
        later = F.lead("x", ahead).over(by) if ahead else F.lit(None).cast("long")
        return df.select("k", "t", past.alias("past"), later.alias("later"), F.count("*").over(by.rowsBetween(1 - depth, 0)).alias("n"))

    return make


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("depth", "ahead"), [(4, 0), (3, 2)])
def test_equals_a_rebuild(spark, tmp_path, depth, ahead):
    rng = random.Random(depth)
    state = {(k, t): rng.randrange(100) for k in "abcdefgh" for t in rng.sample(range(200), 60)}
    frame = lambda: spark.createDataFrame([(k, t, x) for (k, t), x in state.items()], SCHEMA).repartition(3)
    make = windows(depth, ahead)
    table = WindowedTable(spark, str(tmp_path / "t"), ["k"], "t", depth, make, frame(), ahead, buckets=3)
    assert table.refresh(frame()) == {"changed": 480, "read": 480, "made": 480}
    assert rows(table.current()) == rows(make(frame()))
    assert table.refresh(frame())["changed"] == 0
    for _ in range(2):
        for key in rng.sample(sorted(state), 4):  # gone, changed, new: some next to each other
            del state[key]
            state.pop(min((x for x in state if x[0] == key[0] and x[1] > key[1]), default=key), None)
        for key in rng.sample(sorted(state), 2):
            state[key] += 1000
        state[rng.choice("ab"), 300 + rng.randrange(99)] = 5
        state[rng.choice("xyz"), rng.randrange(99)] = 6
        told = table.refresh(frame())
        assert rows(table.current()) == rows(make(frame()))
        assert told["made"] <= told["changed"] * (depth + ahead + 1) and told["read"] <= told["made"] * (depth + ahead + 1)
    for key in [x for x in state if x[0] == "c"]:
        del state[key]
    table.refresh(frame())
    assert rows(table.current()) == rows(make(frame()))


def test_prices_follow_one_bar(spark, tmp_path):
    days = spark.range(300).selectExpr("id", "date_add(DATE'2020-01-01', cast(id AS int)) AS trade_date")
    bars = days.crossJoin(spark.createDataFrame([("A",), ("B",)], "symbol string")).selectExpr("symbol", "trade_date", "10.0D AS open_px", "12.0D AS high_px", "9.0D AS low_px", "round(10 + sin(id), 2) AS close_px", "id AS volume")
    table = WindowedTable(spark, str(tmp_path / "t"), ["symbol"], "trade_date", 50, price_features, bars, buckets=3)
    table.refresh(bars)
    late = bars.withColumn("close_px", F.when((F.col("symbol") == "B") & (F.col("trade_date") == "2020-05-05"), 99.0).otherwise(F.col("close_px")))
    assert table.refresh(late) == {"changed": 1, "read": 99, "made": 50}
    assert sorted(map(str, table.current().collect())) == sorted(map(str, price_features(late).collect()))
