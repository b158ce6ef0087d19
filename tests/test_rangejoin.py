"""Range joins and as-of joins by bins against plain versions."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from skeinflow.operators.asof import asof_join
from skeinflow.operators.rangejoin import asof_rownumber, range_join

DAY = date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + timedelta(n)


@pytest.mark.parametrize("size", [1, 7, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join(spark, size, how):
    rng = random.Random(size)
    points = [(i, rng.choice(["a", "b", None]), day(rng.choice([None, *range(60)]))) for i in range(80)]
    ranges = []
    for j in range(40):
        low = rng.choice([None, *range(-80, 70)])
        ranges.append((j, rng.choice(["a", "b", None]), day(low), day(None if low is None or rng.random() < 0.2 else low + rng.randrange(-2, 50))))
    left, right = spark.createDataFrame(points, "i int, k string, t date"), spark.createDataFrame(ranges, "j int, k string, lo date, hi date")
    got = sorted(((r.i, r.j) for r in range_join(left, right, ["k"], "t", "lo", "hi", ["j"], how, size).collect()), key=str)
    want = [(i, j) for i, k, t in points for j, kk, lo, hi in ranges if k is not None and k == kk and t and lo and lo <= t and (hi is None or t <= hi)]
    if how == "left":
        want += [(i, None) for i, _, _ in points if i not in {x for x, _ in want}]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("size", [3, 64])
def test_asof_equals_the_carrying_join_over_gaps_longer_than_a_bin(spark, size):
    rng = random.Random(4)
    left = [(rng.choice(["a", "b", "c", None]), day(rng.choice([None, *range(0, 2000, 7)])), rng.randrange(3)) for _ in range(150)]
    left += left[:20]  # equal rows
    right = [(k, day(t), rng.randrange(9)) for k in ("a", "b", None) for t in (-900, 3, 4, 4, 700, 1500, 5000, None)]
    a, b = spark.createDataFrame(left, "k string, t date, x int"), spark.createDataFrame(right, "k string, f date, v int")
    got = asof_rownumber(a, b, ["k"], "t", "f", ["v"], size)
    assert sorted(map(str, got.collect())) == sorted(map(str, asof_join(a, b, ["k"], "t", "f", ["v"]).collect()))
    assert got.columns == ["k", "t", "x", "f", "v"]


def test_timestamps_and_numbers(spark):
    a = spark.range(200).selectExpr("id % 3 AS k", "timestamp_seconds(1000 + id * 37.5) AS t", "id")
    b = spark.range(40).selectExpr("id % 4 AS k", "timestamp_seconds(900 + id * 190.25) AS f", "id AS v")
    want = sorted(map(str, asof_join(a, b, ["k"], "t", "f", ["v"]).collect()))
    assert sorted(map(str, asof_rownumber(a, b, ["k"], "t", "f", ["v"], 100).collect())) == want
    n, m = a.withColumn("t", F.col("t").cast("double")), b.withColumn("f", F.col("f").cast("double"))
    assert asof_rownumber(n, m, ["k"], "t", "f", ["v"], 50).select("id", "v").exceptAll(asof_join(n, m, ["k"], "t", "f", ["v"]).select("id", "v")).count() == 0


def test_empty_sides(spark):
    a, b = spark.createDataFrame([("a", DAY)], "k string, t date"), spark.createDataFrame([], "k string, f date, v int")
    assert asof_rownumber(a, b, ["k"], "t", "f", ["v"]).first() == ("a", DAY, None, None)
    assert asof_rownumber(a.filter("false"), b, ["k"], "t", "f", ["v"]).collect() == []
