"""Operators on hand-made rows: edge cases and brute-force versions."""

import random
from datetime import date

import pytest
from hypothesis import given
from hypothesis import settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinflow.functions.exact import mean, sd_population, sd_sample, units
from skeinflow.functions.keys import article_id, chunk_key, sanitised
from skeinflow.functions.text import chunks, lexicon_sentiment, mask_pii
from skeinflow.ml import trees
from skeinflow.ml.folds import assign, folds_frame, walk_forward
from skeinflow.operators.asof import asof_join
from skeinflow.operators.baskets import every_nth, top_k
from skeinflow.operators.metrics import auc, wilcoxon
from skeinflow.operators.numbering import number_rows
from skeinflow.operators.quality import ExpectationError, keep_valid, require
from skeinflow.operators.upsert import upsert, upsert_columns
from skeinflow.operators.vectors import cosine_topk, pack_vector, unpack_vector
from skeinflow.plans.prices import price_features, typed_prices
from skeinflow.sources import landing


@pytest.mark.parametrize("bucket", [False, True])
def test_asof_matches_brute_force(spark, bucket):
    rng = random.Random(4)
    left = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(20)])) for i in range(80)]
    right = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(20)]), rng.randrange(5)) for _ in range(40)]
    got = asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, at int, v int"), ["k"], "t", "at", ["v"], bucket=F.floor(F.col("_at") / 6) if bucket else None)
    found = {r.i: (r.at, r.v) for r in got.collect()}
    for i, k, t in left:
        fits = [(a, v) for rk, a, v in right if rk == k and k is not None and None not in (a, t) and a <= t]
        assert found[i] == max(fits, default=(None, None))
    assert len(found) == len(left)


def test_upserts(spark):
    base = spark.createDataFrame([(1, 1, "a", "x"), (2, 5, "b", "y"), (None, 1, "n", "z")], "k int, seq int, v string, w string")
    change = spark.createDataFrame([(1, 1, "A", "X"), (2, 4, "old", "O"), (3, 1, "c", None), (None, 2, None, "Z")], base.schema)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(upsert(base, change, ["k"], ["seq"])) == sorted([(1, 1, "A", "X"), (2, 5, "b", "y"), (3, 1, "c", None), (None, 2, None, "Z")], key=str)
    assert rows(upsert_columns(base, change, ["k"], ["v"])) == sorted([(1, 1, "A", "x"), (2, 5, "old", "y"), (3, 1, "c", None), (None, 1, None, "z")], key=str)


def test_expectations(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert [r.x for r in keep_valid(df, {"positive": F.col("x") > 0}).collect()] == [1]
    with pytest.raises(ExpectationError, match="2 of 3"):
        require(df, {"positive": F.col("x") > 0})


def test_typed_prices_and_short_series(spark):
    raw = [("s", "2024-01-01", "1", "2", "1", "10.5", ""), ("s", "2024-01-02", "", "nan", "x", " 11 ", "7"), ("s", "2024-01-03", "1", "1", "1", "", "1"), ("s", "2024-01-04", "1", "1", "1", None, "1"), ("s", "2024-01-05", "1", "1", "1", "nan", "1"), ("t", "bad", "1", "1", "1", "1", "1"), ("u", "2024-01-01", "1", "1", "1", "0", "1"), ("u", "2024-01-02", "1", "1", "1", "5", "1")]
    typed = typed_prices(spark.createDataFrame(raw, "symbol string, trade_date string, open string, high string, low string, close string, volume string"))
    assert sorted((r.symbol, r.close_px, r.volume, r.open_px) for r in typed.collect()) == [("s", 10.5, None, 1.0), ("s", 11.0, 7, None), ("u", 0.0, 1, 1.0), ("u", 5.0, 1, 1.0)]
    got = {(r.symbol, str(r.trade_date)): r for r in price_features(typed).collect()}
    assert got["s", "2024-01-01"].log_ret_1d is None and got["s", "2024-01-01"].bb_z == 0.0 and got["s", "2024-01-01"].vol_20d is None
    assert got["u", "2024-01-02"].log_ret_1d is None and got["s", "2024-01-02"].sma_50 == 10.75


@hyp(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-10_000, 10_000)), max_size=30))
def test_exact_statistics(spark, cents):
    import statistics

    df = spark.createDataFrame([(None if c is None else c / 100,) for c in cents], "x double").select(units(F.col("x"), 100).alias("c"))
    r = df.agg(mean(F.col("c"), 100).alias("m"), sd_population(F.col("c"), 100).alias("p"), sd_sample(F.col("c"), 100).alias("s")).first()
    known = [c / 100 for c in cents if c is not None]
    assert (r.m is None) == (not known) and (r.s is None) == (len(known) < 2)
    if known:
        assert r.m == pytest.approx(statistics.mean(known)) and r.p == pytest.approx(statistics.pstdev(known), abs=1e-9)


def test_text_functions(spark):
    df = spark.createDataFrame([("write a.b+c@d-e.co or (555) 123-4567 now",), ("+1 555.123.4567",), (None,), ("plain 12",)], "t string")
    assert [r.m for r in df.select(mask_pii(F.col("t")).alias("m")).collect()] == ["write [EMAIL] or[PHONE] now", "[PHONE]", "", "plain 12"]
    sizes = [0, 49, 50, 499, 500, 501, 950]
    texts = spark.createDataFrame([(n, "w " * n) for n in sizes] + [(-1, None)], "n int, t string")
    found = {n: [r.n_tokens for r in chunks(texts, "t").filter(F.col("n") == n).orderBy("chunk_index").collect()] for n in [*sizes, -1]}
    assert found == {0: [], 49: [], 50: [50], 499: [499], 500: [500, 50], 501: [500, 51], 950: [500, 500, 50], -1: []}
    s = [r.s for r in spark.createDataFrame([("",), (None,), ("gain loss GAIN x",)], "t string").select(lexicon_sentiment(F.col("t")).alias("s")).collect()]
    assert [(x.pos_prob, x.neu_prob, x.neg_prob, x.score) for x in s] == [(0, 1, 0, 0), (0, 1, 0, 0), (0.5, 0.25, 0.25, 0.25)]


def test_keys(spark):
    one = spark.range(1)
    key = one.select(chunk_key(F.lit("10K"), F.lit("AB"), F.lit(date(2024, 9, 29)), F.lit("0000-24-000079"), F.lit(107)).alias("k")).first().k
    assert key == "10K-AB-2024-09-29-000079-c107"
    assert one.select(chunk_key(F.lit("8K"), F.lit("A"), F.lit(date(2024, 9, 29)), F.lit(None).cast("string"), F.lit(3)).alias("k")).first().k == "8K-A-2024-09-29-000000-c03"
    assert one.select(article_id(F.lit(None), F.lit("p"), F.lit("u")).alias("k")).first().k.startswith("::p::")
    assert [sanitised(x) for x in ("grossProfit", "a b-c", "1x", "", "_ok")] == ["grossprofit", "a_b_c", "_1x", "", "_ok"]


def test_folds(spark):
    found = walk_forward(date(2021, 1, 1), date(2026, 4, 30))
    assert len(found) == 14 and found[-1].fold_id.endswith("_partial")
    assert all((f.test_start - f.train_end).days >= 7 for f in found)
    start = date(2021, 1, 1)
    one = date.fromordinal(start.toordinal() + 1095 + 63)
    assert len(walk_forward(start, date.fromordinal(one.toordinal() + 13))) == 1
    assert len(walk_forward(start, date.fromordinal(one.toordinal() + 14))) == 2
    days = spark.createDataFrame([(found[0].test_end,), (found[0].test_start,), (start,)], "trade_date date")
    assert {r.trade_date: r.fold_id for r in assign(days, folds_frame(spark, found)).collect()} == {found[0].test_end: found[1].fold_id, found[0].test_start: found[0].fold_id}


def test_auc_and_wilcoxon(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(6) / 6, rng.randrange(2)) for g in "abc" for _ in range(40)] + [("one", 0.5, 1), ("one", 0.6, 1), ("top", 0.1, 0), ("top", 0.9, 1), ("tie", 0.5, 0), ("tie", 0.5, 1)]
    got = {r.g: r.auc for r in auc(spark.createDataFrame(rows, "g string, p double, y int"), ["g"], "p", "y").collect()}
    for g in ("a", "b", "c", "top", "tie"):
        pos, neg = ([p for x, p, y in rows if x == g and y == v] for v in (1, 0))
        assert got[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert "one" not in got and got["top"] == 1.0 and got["tie"] == 0.5
    w = wilcoxon(spark.createDataFrame([(0.1,), (-0.2,), (0.2,), (0.0,), (0.5,)], "d double"), "d").first()
    assert (w.n, w.w_plus, w.w_minus, w.statistic) == (4, 7.5, 2.5, 2.5)


def test_selection_and_numbers(spark):
    df = spark.createDataFrame([("a", d, i) for d in range(11) for i in range(2)], "g string, d int, i int")
    assert sorted({r.d for r in every_nth(df, ["g"], "d", 5).collect()}) == [0, 5, 10]
    assert [r.i for r in top_k(df, ["g", "d"], [F.desc("i")], 1).collect()] == [1] * 11
    got = sorted((r.n, r.d, r.i) for r in number_rows(df, "d", ["i"], "n", 100).collect())
    assert got == [(100 + k, d, i) for k, (d, i) in enumerate((d, i) for d in range(11) for i in range(2))]


def test_cosine_topk_and_packing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "i long, v array<float>")
    got = sorted((r.query_id, r["rank"], r.item_id, r.similarity) for r in cosine_topk(df.filter("i = 2"), df, "i", "v", 9).collect())
    assert got == [(2, 1, 1, 1.0), (2, 2, 2, 1.0), (2, 3, 3, 0.0), (2, 4, 5, 0.0)]
    assert cosine_topk(df.filter("i = 2"), df, "i", "v", 3, where=F.lit(False)).collect() == []
    assert cosine_topk(df.filter("i = 9"), df, "i", "v", 3).collect() == []
    back = df.select("i", unpack_vector(pack_vector("v")).alias("v")).collect()
    assert [(r.i, r.v) for r in back] == [(1, [1, 0]), (2, [2, 0]), (3, [0, 1]), (4, None), (5, [0, 0])]


def test_landing(spark, tmp_path):
    a, b = spark.createDataFrame([("x", None)], "t string, u string"), spark.createDataFrame([("x", None), ("y", None)], "t string, u string")
    assert [r.t for r in landing.new_rows(b, a, ["t", "u"]).collect()] == ["y"]
    path = str(tmp_path / "slices")
    landing.replace_slice(spark.createDataFrame([(0, "a"), (1, "b")], "r int, v string"), path, "r")
    landing.replace_slice(spark.createDataFrame([(1, "c")], "r int, v string"), path, "r")
    assert sorted((r.r, r.v) for r in spark.read.parquet(path).collect()) == [(0, "a"), (1, "c")]
    sums = landing.checksums(spark, path)
    assert all(len(r.sha256) == 64 for r in sums.collect()) and len(landing.manifest_checksum(sums).first().sha256) == 64
    texts = tmp_path / "filings" / "AB"
    texts.mkdir(parents=True)
    (texts / "2024-01-02_77.txt").write_text("body\nmore")
    (texts / "2024-01-03_78.txt").write_text("  ")
    got = landing.whole_texts(spark, str(tmp_path / "filings"), r"([A-Z]+)/(\d{4}-\d{2}-\d{2})").collect()
    assert [(r.symbol, str(r.filing_date), r.accession, r.body) for r in got] == [("AB", "2024-01-02", "2024-01-02_77.txt", "body\nmore")]
    (tmp_path / "j.json").write_text('{"a": 1}')
    (tmp_path / "k.json").write_text('{"a": ')
    good, bad = landing.read_json_documents(spark, str(tmp_path / "*.json"), "a int")
    assert [r.a for r in good.collect()] == [1] and [r.asDict() for r in bad.collect()] == [{"a": None, "_corrupt_record": '{"a": '}]
    log = landing.audit_row(spark, "s", None, "w", "p", 1, None)
    assert landing.log_ingest(log, landing.audit_row(spark, "s", None, "w", "p", 2, "f" * 64)).first().row_count == 2
    assert landing.as_text(spark.createDataFrame([(date(2024, 1, 2), 3)], "`a Day` date, n int")).collect()[0].asDict() == {"a_day": "2024-01-02", "n": "3"}


def test_models():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    start, found = trees.fit(x[:1500], y[:1500])
    score = start + sum(trees.walk(t, x[1500:]) for t in found)
    assert ((score > 0) == y[1500:]).mean() > 0.9
    credits, bases = zip(*(trees.shapley(t, x[1500:1600]) for t in found), strict=True)
    assert np.allclose(sum(credits).sum(axis=1) + sum(bases), score[:100] - start)
    shares = trees.importances(found, ["a", "b", "c", "d"])
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] + shares["b"] > 0.55
