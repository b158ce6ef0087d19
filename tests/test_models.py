"""Models on small series and panels against plain loops."""

import itertools
import json
import pickle
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.ml import autoregression as ar
from skeinflow.ml import trees
from skeinflow.ml.folds import Fold, folds_frame
from skeinflow.operators.metrics import signed_rank_chance, signed_rank_test
from skeinflow.plans import evaluation, fixtures, reports

DAYS = [date(2000, 1, 1) + timedelta(i) for i in range(200)]
FOLDS = [Fold("a", DAYS[0], DAYS[99], DAYS[110], DAYS[140]), Fold("b", DAYS[40], DAYS[139], DAYS[150], DAYS[199]), Fold("none", date(1990, 1, 1), date(1990, 2, 1), DAYS[0], DAYS[9])]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in ("x", "y", "z"):
        for i, day in enumerate(DAYS):
            a, b = rng.normal(size=2)
            rows.append((f"d{i}", c, day, float(a), None if i % 17 == 0 else float(b), None if i % 41 == 0 else int(a + b > 0), float(rng.normal() * 0.01)))
    return spark.createDataFrame(rows, "date_key string, company_key string, trade_date date, f1 double, f2 double, y_5d_up long, log_ret_1d double")


def test_series():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=2000)
    auto, moving = np.zeros(2000), noise.copy()
    for i in range(1, 2000):
        auto[i] = 0.8 * auto[i - 1] + noise[i]
        moving[i] = noise[i] + 0.7 * noise[i - 1]
    lags, errors, d, *_ = ar.fit(auto)
    assert d == 0 and abs(lags[0] - 0.8) < 0.1
    assert abs(ar.forecast(auto, 1)[0] - 0.8 * auto[-1]) < 0.3
    lags, errors, d, *_ = ar.fit(moving)
    assert d == 0 and abs(ar.forecast(moving, 1)[0] - 0.7 * noise[-1]) < 0.4 and abs(ar.forecast(moving, 9)[8]) < 0.4
    walk = np.cumsum(noise)
    assert ar.wanders(walk) and not ar.wanders(noise) and ar.fit(walk)[2] == 1
    assert abs(ar.forecast(walk, 1)[0] - walk[-1]) < 1
    assert ar.probability(auto[:59]) == 0.5 and 0 < ar.probability(auto) < 1
    assert [len(ar.thinned(n)) for n in (0, 5, 20, 21, 45, 400)] == [0, 5, 20, 20, 20, 20] and ar.thinned(45)[1] == 2


def simulated(phi, theta, n, seed):
    noise = np.random.default_rng(seed).normal(size=n + 300) * 0.02
    out = np.zeros(n + 300)
    for t in range(2, n + 300):
        out[t] = sum(p * out[t - 1 - i] for i, p in enumerate(phi)) + noise[t] + sum(q * noise[t - 1 - i] for i, q in enumerate(theta))
    return out[300:]


@pytest.mark.parametrize(("phi", "theta"), [((0.6,), ()), ((), (0.5,)), ((), (1.2, 0.5)), ((0.7,), (-0.3,)), ((0.5, 0.3), ()), ((0.4, -0.5), (0.3, 0.4)), ((), ())])
def test_known_processes_are_recovered(phi, theta):
    series = simulated(phi, theta, 3000, 3)
    lags, errors, d, left, criterion = ar.fit(series)
    # the weights' response to a shock tells processes that are written in several ways apart
    answer = lambda p, q: np.array(list(itertools.islice(_response(list(p), list(q)), 8)))
    assert d == 0 and np.abs(answer(lags, errors) - answer(phi, theta)).max() < 0.12
    assert abs(left[50:].std() - 0.02) < 0.001


def _response(phi, theta):
    past = []
    for t in itertools.count():
        now = (1.0 if t == 0 else 0.0) + (theta[t - 1] if 0 < t <= len(theta) else 0.0) + sum(p * past[t - 1 - i] for i, p in enumerate(phi) if t > i)
        past.append(now)
        yield now


def test_the_likelihood_is_exact_and_no_worse_than_rough_weights():
    series = simulated((0.5, 0.2), (0.4,), 60, 1)
    lags, errors = np.array([[0.5, 0.2], [-0.3, 0.1], [0.0, 0.0]]), np.array([[0.4, 0.0], [0.2, 0.3], [-0.6, 0.2]])
    v, f = ar.innovations(series, lags, errors)
    for m in range(3):
        weights = np.array(list(itertools.islice(_response(lags[m].tolist(), errors[m].tolist()), 3000)))
        cover = np.array([weights[: len(weights) - k] @ weights[k:] for k in range(60)])
        whole = cover[np.abs(np.subtract.outer(np.arange(60), np.arange(60)))]
        want = series @ np.linalg.solve(whole, series), np.linalg.slogdet(whole)[1]
        assert np.allclose([(v[:, m] ** 2 / f[:, m]).sum(), np.log(f[:, m]).sum()], want, rtol=1e-6)
    for seed in range(4):
        long = simulated((0.3,), (0.5,), 300, seed)
        best = ar.fit(long)[4]
        start = np.array([np.concatenate([ar._free(p), ar._free(-q)]) for p, q in ar._rough(long)])
        rough = ar._cost(long, start) + 2 * (np.array([p + q for p, q in ar.ORDERS]) + 1)
        assert best <= rough.min() + 1e-2


def test_rung_0_walks_forward(spark, panel):
    got = {(r.company_key, r.date_key): (r.fold_id, r.prob_up, r.predicted_class) for r in ar.walk_forward(panel, folds_frame(spark, FOLDS)).collect()}
    rows = panel.collect()
    want = {}
    for f in FOLDS:
        for c in ("x", "y", "z"):
            mine = sorted((r for r in rows if r.company_key == c), key=lambda r: r.trade_date)
            train = np.array([r.log_ret_1d for r in mine if f.train_start <= r.trade_date <= f.train_end])
            test = [r for r in mine if f.test_start <= r.trade_date <= f.test_end]
            p = round(ar.probability(train), 5)
            step = max(1, len(test) // 20)
            for r in (test[::step][:20] if len(test) > 20 else test):
                want[c, r.date_key] = (f.fold_id, p, int(p > 0.5))
    assert got == want


def test_rung_0_of_the_queries_predicts_every_test_day(spark):
    """As ``rung0_ar`` and ``fitted_backtest`` take it: none of a window's days is left out."""
    from skeinflow.plans import catalog

    days = [date(1998, 1, 2) + timedelta(i) for i in range(90)]  # too few to fit: no time goes into fits
    rows = spark.createDataFrame([(f"{c}{i}", c, day, 0.01 * i) for c in ("x", "y") for i, day in enumerate(days)], "date_key string, company_key string, trade_date date, log_ret_1d double")
    folds = catalog._folds(spark).collect()
    want = sorted((c, f"{c}{i}", f.fold_id) for c in ("x", "y") for i, day in enumerate(days) for f in folds if f.test_start <= day <= f.test_end)
    assert max(sum(k[0] == "x" and k[2] == f.fold_id for k in want) for f in folds) > 50
    assert sorted((r.company_key, r.date_key, r.fold_id) for r in catalog._rung0(spark, None, rows).collect()) == want


@pytest.mark.parametrize("fit_rows", [200_000, 120])
def test_trees_walk_forward(spark, panel, fit_rows):
    use = trees.Settings(trees=20, fit_rows=fit_rows)
    models = trees.fit_folds(panel, folds_frame(spark, FOLDS), ["f1", "f2"], use)
    assert {r.fold_id for r in models.collect()} == {"a", "b"} and all(r.n_rows <= fit_rows for r in models.collect())
    got = trees.predict(panel, folds_frame(spark, FOLDS), models, ["f1", "f2"], 1).collect()
    rows = {(r.date_key, r.company_key): r for r in panel.filter("y_5d_up IS NOT NULL").collect()}
    for f in FOLDS[:2]:
        test = sorted((r for r in rows.values() if f.test_start <= r.trade_date <= f.test_end), key=lambda r: (r.trade_date, r.company_key))
        mine = {(r.date_key, r.company_key): r for r in got if r.fold_id == f.fold_id}
        assert set(mine) == {(r.date_key, r.company_key) for r in test}
        explained = [k for k, r in mine.items() if r.attributions]
        assert set(explained) == {(r.date_key, r.company_key) for r in test[: trees.EXPLAINED]}
        if fit_rows > 1000:
            train = sorted((r for r in rows.values() if f.train_start <= r.trade_date <= f.train_end), key=lambda r: (r.trade_date, r.company_key))
            x = lambda part: np.array([[r.f1 or 0.0, r.f2 or 0.0] for r in part])
            start, found = trees.fit(x(train), np.array([r.y_5d_up for r in train], float), use)
            score = start + sum(trees.walk(t, x(test)) for t in found)
            for r, s in zip(test, score, strict=True):
                one = mine[r.date_key, r.company_key]
                assert abs(one.prob_up - 1 / (1 + np.exp(-s))) < 1e-5 and one.predicted_class == int(one.prob_up > 0.5)
            right = np.mean([mine[r.date_key, r.company_key].predicted_class == r.y_5d_up for r in test])
            assert right > 0.8
    assert all(set(json.loads(r.attributions)) <= {"f1", "f2"} for r in got if r.attributions)
    params = evaluation.run_params(models, 1, "trees", 2).collect()
    assert {(r.fold_id, r.metric) for r in params} == {(f, m) for f in "ab" for m in ("n_features", "n_fit_rows", "fi_f1", "fi_f2")}


@pytest.mark.parametrize("use", [trees.Settings(trees=7), trees.Settings(trees=5, depth=3, rows=1.0, absolute=0.5, least=8.0)])
def test_trees_are_fitted_on_all_rows(spark, panel, monkeypatch, use):
    """A fold is fitted whole: beyond what one task takes, blocks of rows give the trees that the rows give together."""
    monkeypatch.setattr(trees, "BLOCK", 70)
    monkeypatch.setattr(trees, "KEEP", 3)
    more = panel.withColumn("f3", F.round(F.col("f1"))).withColumn("f4", F.lit(2.0))
    features = ["f1", "f2", "f3", "f4"]
    rows = more.filter("y_5d_up IS NOT NULL").collect()
    folds = [FOLDS[0], Fold("b", DAYS[60], DAYS[139], DAYS[150], DAYS[199]), FOLDS[2]]
    for alone in (200_000, 100, 250):  # in one task, in blocks, one fold each way
        monkeypatch.setattr(trees, "ALONE", alone)
        models = {r.fold_id: r for r in trees.fit_folds(more, folds_frame(spark, folds), features, use).collect()}
        assert set(models) == {"a", "b"}
        for f in folds[:2]:
            mine = sorted((r for r in rows if f.train_start <= r.trade_date <= f.train_end), key=lambda r: (r.trade_date, r.company_key))
            want = trees.fit(np.array([[r[c] or 0.0 for c in features] for r in mine]), np.array([r.y_5d_up for r in mine], float), use)
            start, made = pickle.loads(models[f.fold_id].model)
            assert models[f.fold_id].n_rows == len(mine) and (start, made) == want
            assert sum(_count(t) for t in made) > 5 and models[f.fold_id].importances == trees.importances(made, features)


def test_no_rung_leaves_rows_out(spark):
    """More rows than one task takes, under a rung's own settings but for the number of trees."""
    n = 250_000
    day = F.date_add(F.lit(DAYS[0]), (F.col("id") % 100).cast("int"))
    wide = spark.range(n).select(F.col("id").cast("string").alias("date_key"), F.lpad(F.col("id").cast("string"), 9, "0").alias("company_key"), day.alias("trade_date"), F.rand(1).alias("f1"), (F.col("id") % 7).cast("double").alias("f2"), F.lit(0.01).alias("log_ret_1d"))
    wide = wide.withColumn("y_5d_up", (F.col("f1") * 7 > F.col("f2")).cast("long"))
    for rung in (trees.RUNG_1, trees.RUNG_2):
        model = trees.fit_folds(wide, folds_frame(spark, FOLDS[:1]), ["f1", "f2"], replace(rung, trees=2)).collect()
        assert [r.n_rows for r in model] == [n]


def test_driving_rungs(spark, panel, tmp_path):
    folds = folds_frame(spark, [Fold(f"f{i}", DAYS[0], DAYS[60], DAYS[70 + 30 * i], DAYS[99 + 30 * i]) for i in range(4)])
    named = panel.withColumn("symbol", F.col("company_key"))
    path = str(tmp_path / "p")
    _, _, test = evaluation.drive_rung(named, folds, ["f1"], 2, trees.Settings(trees=5), path)
    assert test.collect() == []
    evaluation.drive_rung(named, folds, ["f2"], 1, trees.Settings(trees=5), path)
    kept, metrics, test = evaluation.drive_rung(named, folds, ["f1", "f2"], 2, trees.Settings(trees=5), path)
    assert {r.model_rung for r in kept.select("model_rung").distinct().collect()} == {1, 2}
    assert test.first().n_pairs == 4 and metrics.filter("metric = 'test_auc'").count() == 8


def test_rungs_differ():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 6)), (rng.random(400) > 0.5).astype(float)
    splits = lambda use: sum(_count(t) for t in trees.fit(x, y, use)[1])
    assert splits(trees.RUNG_2) < splits(trees.RUNG_1)


def _count(node):
    return 0 if node.feature < 0 else 1 + _count(node.low) + _count(node.high)


def test_predictions_are_kept_by_rung(spark, tmp_path):
    make = lambda rung, p: spark.createDataFrame([("d", "c", rung, "f", p, 1)], "date_key string, company_key string, model_rung long, fold_id string, prob_up double, predicted_class long")
    path = str(tmp_path / "p")
    evaluation.keep_predictions(make(1, 0.1), path)
    evaluation.keep_predictions(make(2, 0.2), path)
    kept = evaluation.keep_predictions(make(1, 0.3), path)
    assert sorted((r.model_rung, r.prob_up, r.trade_date) for r in kept.collect()) == [(1, 0.3, None), (2, 0.2, None)]


@pytest.mark.parametrize("n", [1, 3, 6, 9])
def test_signed_rank_chance(n):
    for w in range(n * (n + 1) // 4 + 1):
        below = sum(sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) <= w for signs in itertools.product((0, 1), repeat=n))
        assert signed_rank_chance(n, w, [1] * n) == pytest.approx(min(1, 2 * below / 2**n))


def test_signed_rank_test(spark):
    df = lambda *x: spark.createDataFrame([(float(v),) for v in x], "d double")
    r = signed_rank_test(df(0.1, 0.2, 0.3, 0.4, 0.5), "d").first()
    assert (r.n_pairs, r.statistic, r.p_value) == (5, 0, 0.0625) and r.mean_difference == 0.3
    assert signed_rank_test(df(0.1, 0.2), "d").collect() == []
    assert signed_rank_test(df(0, 0, 0), "d").first().p_value is None
    tied = signed_rank_test(df(*[0.1] * 30, *[-0.1] * 10), "d").first()
    assert 0 < tied.p_value < 0.01
    assert signed_rank_chance(100, 2525, [1] * 100) == pytest.approx(1)


def test_components_read_all_dimensions(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.symbol, r.as_of_date): r for r in fixtures.embedding_facts(spark, sf).collect()}
    pooled = {(r.symbol, r.as_of_date): np.array([r[f"v{i}"] for i in range(1, 65)]) for r in fixtures.pooled_vectors(spark, sf).collect()}
    assert set(got) == set(pooled)
    order = sorted(got, key=lambda k: (got[k].company_key, k[1]))
    assert [got[k].fact_embedding_key for k in order] == list(range(1000, 1000 + len(order)))
    matrix = np.stack([pooled[k] for k in order])
    centred = matrix - matrix.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for i in range(5):
        mine = np.array([got[k][f"filing_pc{i + 1}"] for k in order])
        assert abs(abs(mine @ (centred @ axes[i])) / np.linalg.norm(mine) / np.linalg.norm(centred @ axes[i]) - 1) < 1e-3


def test_reports_of_few_rows(spark):
    schema = "symbol string, company_key string, trade_date date, model_rung long, prob_up double, predicted_class long"
    preds = spark.createDataFrame([("A", "a", DAYS[0], 2, 0.6, 1), ("A", "a", DAYS[1], 2, 0.7, 1), ("B", "b", DAYS[1], 1, 0.4, 0)], schema)
    dim = spark.createDataFrame([("a", "A", "s"), ("b", "B", "t")], "company_key string, symbol string, sector_name string")
    assert [r.trade_date for r in reports.days_of(preds, "A").collect()] == [DAYS[1], DAYS[0]]
    assert [(r.model_rung, r.prob_up) for r in reports.predictions_of(preds, "A", str(DAYS[0])).collect()] == [(2, 0.6)]
    assert reports.predictions_of(preds, "Z", str(DAYS[0])).collect() == []
    panels = reports.panels(reports.latest_at_rung(preds, dim))
    assert {k: v.count() for k, v in panels.items()} == {"top5": 2, "sectors": 1, "distribution": 1}
    pnl = spark.createDataFrame([], "model_rung long, trade_date date, cum_net_ret double, benchmark_cum double")
    aucs = spark.createDataFrame([(1, "f", 0.5)], "model_rung long, fold_id string, auc double")
    assert list(reports.datasets(preds, dim, pnl, aucs)) == ["top5", "sectors", "distribution", "fold_auc", "rung_pivot"]
    back = spark.createDataFrame([('{"f": -0.5}',), ("{",), (None,)], "j string").select(reports.decoded(F.col("j")).alias("m")).collect()
    assert [r.m for r in back] == [{"f": -0.5}, {"f": None} if back[1].m else back[1].m, None]


def test_attributions_are_shapley_values():
    """Against the sum over all coalitions, on trees that split twice on a feature; values and base sum to the score."""
    from itertools import combinations
    from math import factorial

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 5)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2) | (x[:, 0] > 1.2)).astype(float)
    start, made = trees.fit(x, y, trees.Settings(trees=6, depth=4, rate=0.5, rows=1.0, columns=1.0, least=1.0, gain=0.0))
    some = x[:25]

    def worth(node, row, known):
        if node.feature < 0:
            return node.value
        if node.feature in known:
            return worth(node.low if row[node.feature] <= node.bound else node.high, row, known)
        return (worth(node.low, row, known) * node.low.cover + worth(node.high, row, known) * node.high.cover) / (node.low.cover + node.high.cover)

    twice = 0
    for tree in made:
        credit, base = trees.shapley(tree, some)
        assert np.allclose(credit.sum(axis=1) + base, trees.walk(tree, some))
        for i, row in enumerate(some):
            for f in range(5):
                others = [g for g in range(5) if g != f]
                want = sum(factorial(n) * factorial(4 - n) / factorial(5) * (worth(tree, row, {*c, f}) - worth(tree, row, set(c))) for n in range(5) for c in combinations(others, n))
                assert abs(credit[i, f] - want) < 1e-9
                twice += want != 0
    assert twice


def test_no_fold_knows_a_later_filing(spark):
    """Bases by merged sums against those of the rows themselves, and unmoved by what comes after a fold's training."""
    from skeinflow.ml import pca

    rng = np.random.default_rng(8)
    turn = rng.normal(size=(6, 6))
    rows = [(c, DAYS[i], (rng.normal(size=6) @ turn + i / 50).tolist()) for i in range(0, 200, 4) for c in ("x", "y")]
    schema = "company_key string, as_of_date date, vector array<double>"
    folds = folds_frame(spark, FOLDS)
    bases = pca.fold_bases(spark.createDataFrame(rows, schema).repartition(3), "as_of_date", "vector", {f.fold_id: f.train_end for f in FOLDS}, 3)
    for f in FOLDS:
        own = np.array([v for _, day, v in rows if day <= f.train_end])
        mean, axes = bases[f.fold_id]
        if len(own) < 2:
            assert not axes.any()
            continue
        _, _, want = np.linalg.svd(own - own.mean(axis=0), full_matrices=False)
        assert np.allclose(mean, own.mean(axis=0)) and np.allclose(np.abs((want[:3] * axes.T).sum(axis=1)), 1)
    got = {(r.fold_id, r.company_key, r.as_of_date): tuple(r)[3:] for r in pca.fold_components(spark.createDataFrame(rows, schema), "as_of_date", "vector", folds, 3).collect()}
    end = FOLDS[0].train_end
    later = [(c, day, v if day <= end else [9.0 * x * x for x in v]) for c, day, v in rows]
    again = {(r.fold_id, r.company_key, r.as_of_date): tuple(r)[3:] for r in pca.fold_components(spark.createDataFrame(later, schema), "as_of_date", "vector", folds, 3).collect()}
    mine = [k for k in got if k[0] == "a" and k[2] <= end]
    assert mine and all(got[k] == again[k] for k in mine)
    assert {k[0] for k in got} == {"a", "b", "none"} and max(k[2] for k in got if k[0] == "a") <= FOLDS[0].test_end
    assert any(got[k] != again[k] for k in got if k[0] == "b" and k[2] <= end)


def test_features_known_by_fold(spark, panel):
    """A fold's own features reach its rows by day, and only its rows."""
    known = spark.createDataFrame([("a", "x", DAYS[5], 1.0), ("a", "x", DAYS[50], 2.0), ("b", "x", DAYS[50], 7.0)], "fold_id string, company_key string, as_of_date date, pc double")
    rows = trees._windows(panel, folds_frame(spark, FOLDS), ["f1", "pc"], "y_5d_up", known).collect()
    for r in rows:
        want = 0.0 if r.company_key != "x" or r.fold_id == "none" else 7.0 * (r.trade_date >= DAYS[50]) if r.fold_id == "b" else 2.0 if r.trade_date >= DAYS[50] else 1.0 * (r.trade_date >= DAYS[5])
        assert r.pc == want
    assert len(rows) == trees._windows(panel, folds_frame(spark, FOLDS), ["f1"], "y_5d_up").count()


def test_a_panel_reads_the_large_tables_once(spark):
    from skeinflow.plans.catalog import QUERIES

    for name in ("feature_panel", "feature_panel_pca"):
        read = " ".join(QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles())
        assert not [t for t in ("orders", "lineitem", "events", "embeddings") if f"/{t}.parquet" in read]  # its parts were written
