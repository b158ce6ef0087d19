"""The fitted scorer on texts whose classes are known."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.ml import sentiment
from skeinflow.plans.scoring import score_articles

WORDS = {0: ["awful", "loss", "not good"], 1: ["report", "meeting", "said"], 2: ["great", "gain", "good"]}


def rows(rng, n):
    out = []
    for i in range(n):
        label = i % 3
        text = " ".join(rng.choice(WORDS[label]) if rng.random() < 0.3 else rng.choice(["the", "of", "Company", "news", "day"]) for _ in range(25))
        out.append((i, text, label))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return sentiment.fit(spark.createDataFrame(rows(random.Random(1), 600), "id long, text string, label int"))


def test_held_out_accuracy(spark, model):
    held = spark.createDataFrame(rows(random.Random(2), 300), "id long, text string, label int")
    got = model.scored(held, "text").collect()
    right = sum(max(zip((r.s.neg_prob, r.s.neu_prob, r.s.pos_prob), (0, 1, 2), strict=True))[1] == r.label for r in got)
    assert right >= 285
    assert all(abs(r.s.pos_prob + r.s.neu_prob + r.s.neg_prob - 1) < 2e-5 and abs(r.s.score - (r.s.pos_prob - r.s.neg_prob)) < 2e-5 for r in got)


def test_blank_texts_are_neutral_and_columns_stay(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (2, " .,- ", "y"), (3, "great gain good", "z")], "id long, text string, _terms string")
    got = {r.id: r for r in model.scored(df, "text").collect()}
    assert tuple(got[1].s) == tuple(got[2].s) == (0.0, 1.0, 0.0, 0.0) and got[3].s.score > 0.5 and got[3]["_terms"] == "z"


def test_nothing_to_learn_from(spark):
    none = sentiment.fit(spark.createDataFrame([("a", None), (" ", 1)], "text string, label int"))
    assert tuple(none.scored(spark.createDataFrame([("great",)], "text string"), "text").first().s) == (0.0, 1.0, 0.0, 0.0)


def test_kept_models_and_articles(spark, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = sentiment.FittedSentiment.load(str(tmp_path / "m"))
    rows = spark.createDataFrame([("k", "A", "2024-01-02 03:04:05", "great good gain"), ("l", "A", "never", "")], "key string, symbol string, published_at string, body string")
    got = {r.key: r for r in score_articles(rows, "key", "body", again).collect()}
    assert got["k"].pos_prob > 0.5 and str(got["k"].trade_date) == "2024-01-02" and got["l"].neu_prob == 1.0 and got["l"].trade_date is None
    assert got["k"].pos_prob == model.scored(rows.filter(F.col("key") == "k"), "body").first().s.pos_prob


def test_texts_are_counted_once(spark):
    from skeinflow.functions.encoder import encode

    read = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows(random.Random(3), 300), "id long, text string, label int").repartition(3)
    seen = encode(F.col("text"), lambda texts: read.add(len(texts)) or np.ones((len(texts), 1)))
    told = df.withColumn("text", F.when(F.get(seen, 0) > 0, F.col("text")))
    assert sentiment.fit(told).scored(df, "text").count() == 300 and read.value == 300


def test_terms(spark):
    df = spark.createDataFrame([("One, two THREE",), ("x",), ("",), (None,)], "t string")
    assert [r.w for r in df.select(sentiment.terms(F.col("t")).alias("w")).collect()] == [["one", "two", "three", "one two", "two three"], ["x"], [], []]
