"""Forecasts of five days by autoregression and moving averages, one fit per company and fold.

Up to LAGS lags of the series and of its errors, after a difference if the series wanders; without intercept. All orders
are fitted at once by exact Gaussian likelihood (a Kalman filter over the state-space form, whose steady state is the plain
recursion of errors), from estimates by a long autoregression (Hannan and Rissanen, 1982); the order with the least
information criterion is taken. Weights stay stationary and invertible, since they are fitted as partial correlations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest returns, the returns whose deviation scales a forecast, days ahead, longest lags, differences.
FEWEST, RECENT, AHEAD, LAGS, DIFFERENCES = 60, 60, 5, 2, 1
#: Numbers of lags and of errors that are tried.
ORDERS = [(p, q) for p in range(LAGS + 1) for q in range(LAGS + 1)]
#: Greatest partial correlation, change of the forecast's variance at which it has settled, steps of the descent, width of
#: its differences, the parts of a step that are tried, and the gain at which it ends.
EDGE, STEADY, STEPS, WIDTH, ENOUGH = 0.98, 1e-9, 25, 1e-4, 1e-2
REACH = np.array([2.0, 1.0, 0.5, 0.2, 0.05, 0.005])
#: Test days of a company and fold that ``walk_forward`` predicts where it isn't told otherwise, evenly thinned, as its model
#: does. The queries predict all.
MOST = 20
#: The 5 % point of the test of level stationarity (Kwiatkowski et al., 1992).
WANDERS = 0.463


def wanders(series: np.ndarray) -> bool:
    """Whether level stationarity is rejected."""
    n = len(series)
    e = series - series.mean()
    lags = int(12 * (n / 100) ** 0.25)
    long_run = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    return long_run > 0 and float((np.cumsum(e) ** 2).sum()) / n**2 / long_run > WANDERS


def _lagged(x: np.ndarray, lags: int, first: int) -> np.ndarray:
    return np.stack([x[first - i : len(x) - i] for i in range(1, lags + 1)], axis=1) if lags else np.zeros((len(x) - first, 0))


def _least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0] if x.shape[1] else np.zeros(0)


def _rough(series: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights of the lags, of the errors), each padded to LAGS, for every order, by least squares."""
    long = min(10, len(series) // 10)
    rough = np.concatenate([np.zeros(long), series[long:] - _lagged(series, long, long) @ _least_squares(_lagged(series, long, long), series[long:])])
    first = long + LAGS
    out = []
    for p, q in ORDERS:
        beta = _least_squares(np.concatenate([_lagged(series, p, first), _lagged(rough, q, first)], axis=1), series[first:])
        out.append((np.pad(beta[:p], (0, LAGS - p)), np.pad(beta[p:], (0, LAGS - q))))
    return out


def _weights(u: np.ndarray) -> np.ndarray:
    """Weights of two lags from free numbers: partial correlations below EDGE. Those of errors have the other sign."""
    r = EDGE * np.tanh(u)
    return np.stack([r[..., 0] * (1 - r[..., 1]), r[..., 1]], axis=-1)


def _free(weights: np.ndarray) -> np.ndarray:
    """The numbers of ``_weights``, of the nearest weights that are allowed."""
    second = np.clip(weights[..., 1], -0.95, 0.95)
    first = np.clip(weights[..., 0] / (1 - second), -0.95, 0.95)
    return np.arctanh(np.stack([first, second], axis=-1) / EDGE)


def innovations(series: np.ndarray, lags: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(errors of one-step forecasts, their variances in units of the noise), each (time, models), exactly from the
    stationary start on, for models (lags, errors: models by two)."""
    n, m = len(series), len(lags)
    turn = np.zeros((m, 3, 3))
    turn[:, 0, 0], turn[:, 1, 0], turn[:, 0, 1], turn[:, 1, 2] = lags[:, 0], lags[:, 1], 1, 1
    noise = np.concatenate([np.ones((m, 1)), errors], axis=1)
    shock = noise[:, :, None] * noise[:, None, :]
    kron = np.einsum("mij,mkl->mikjl", turn, turn).reshape(m, 9, 9)
    spread = np.linalg.solve(np.eye(9) - kron, shock.reshape(m, 9, 1)).reshape(m, 3, 3)
    state, v, f = np.zeros((m, 3)), np.zeros((n, m)), np.ones((n, m))
    steady, at = np.full(m, n), np.arange(m)  # when a model's forecasts have settled, and the models that haven't
    for t in range(n):
        v[t, at], f[t, at] = series[t] - state[:, 0], spread[:, 0, 0]
        gain = (turn @ spread[:, :, :1])[:, :, 0] / f[t, at][:, None]
        state = (turn @ state[:, :, None])[:, :, 0] + gain * v[t, at][:, None]
        spread = turn @ spread @ turn.transpose(0, 2, 1) + shock - gain[:, :, None] * gain[:, None, :] * f[t, at][:, None, None]
        if t % 8 == 7:
            settled = np.abs(spread[:, 0, 0] - 1) < STEADY
            steady[at[settled]] = t + 1
            at, state, spread, turn, shock = (x[~settled] for x in (at, state, spread, turn, shock))
            if not len(at):
                break
    first = int(steady.min())
    if first < n:
        # the forecast's variance has settled: errors follow from the series and the errors before
        whole = series[:, None] - np.concatenate([np.zeros((1, m)), series[:-1, None] * lags[:, 0]]) - np.concatenate([np.zeros((2, m)), series[:-2, None] * lags[:, 1]])
        one, two, near, far = v[first - 1], v[first - 2], errors[:, 0].copy(), errors[:, 1].copy()
        for t in range(first, n):
            one, two = np.where(steady <= t, whole[t] - near * one - far * two, v[t]), one
            v[t] = one
    return v, f


def _cost(series: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Minus twice the log likelihood, up to a constant, of models (free numbers of the lags, then of the errors)."""
    v, f = innovations(series, _weights(u[:, :2]), -_weights(u[:, 2:]))
    return len(series) * np.log(np.maximum((v * v / f).mean(axis=0), 1e-300)) + np.log(f).sum(axis=0)


def _minimised(series: np.ndarray, u: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, costs) of all models after steps of quasi-Newton descent, where ``free`` numbers may change."""
    m, d = u.shape
    cost = _cost(series, u)
    inverse = np.tile(np.eye(d) * 0.5 / len(series), (m, 1, 1))
    before = None
    for _ in range(STEPS):
        moves = WIDTH * np.eye(d)
        both = np.concatenate([u[:, None] + moves, u[:, None] - moves], axis=1).reshape(-1, d)
        high, low = _cost(series, both).reshape(m, 2, d).transpose(1, 0, 2)
        slope = np.where(free, (high - low) / (2 * WIDTH), 0)
        if before is not None:
            s, y = u - before[0], slope - before[1]
            sy = (s * y).sum(axis=1)
            good = sy > 1e-12
            rho = np.where(good, 1 / np.where(good, sy, 1), 0)[:, None, None]
            side = np.eye(d) - rho * s[:, :, None] * y[:, None, :]
            inverse = np.where(good[:, None, None], side @ inverse @ side.transpose(0, 2, 1) + rho * s[:, :, None] * s[:, None, :], inverse)
        way = -(inverse @ slope[:, :, None])[:, :, 0]
        way = np.where((way * slope).sum(axis=1, keepdims=True) < 0, way, -slope / len(series))
        way *= np.minimum(1, 1 / np.maximum(np.abs(way).max(axis=1, keepdims=True), 1e-30))
        tried = u[:, None] + REACH[:, None] * way[:, None]
        costs = _cost(series, tried.reshape(-1, d)).reshape(m, -1)
        best = costs.argmin(axis=1)
        better = costs[np.arange(m), best] < cost
        before = (u, slope)
        u = np.where(better[:, None], tried[np.arange(m), best], u)
        gained = np.where(better, cost - costs[np.arange(m), best], 0)
        cost = cost - gained
        if gained.max() < ENOUGH:
            break
    return u, cost


def fit(series: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, float]:
    """(weights of the lags, of the errors, differences taken, errors of one-step forecasts, information criterion) of the
    best order."""
    d = 0
    while d < DIFFERENCES and wanders(series):
        series, d = np.diff(series), d + 1
    scale = float(np.sqrt((series * series).mean())) or 1.0
    series = series / scale
    start = np.array([np.concatenate([_free(lags), _free(-errors)]) for lags, errors in _rough(series)])
    free = np.array([[i < p for i in range(LAGS)] + [i < q for i in range(LAGS)] for p, q in ORDERS])
    u, cost = _minimised(series, np.where(free, start, 0), free)
    criterion = cost + 2 * (free.sum(axis=1) + 1)
    best = int(criterion.argmin())
    lags, errors = _weights(u[best : best + 1, :2]), -_weights(u[best : best + 1, 2:])
    left, _ = innovations(series, lags, errors)
    return lags[0], errors[0], d, left[:, 0] * scale, float(criterion[best] + 2 * len(series) * math.log(scale))


def forecast(series: np.ndarray, ahead: int = AHEAD) -> np.ndarray:
    """The next values of the series."""
    lags, errors, d, left, _ = fit(series)
    past, shocks = list(np.diff(series) if d else series), list(left)
    out = []
    for _ in range(ahead):
        step = sum(b * past[-1 - i] for i, b in enumerate(lags)) + sum(b * shocks[-1 - i] for i, b in enumerate(errors))
        past.append(step)
        shocks.append(0.0)
        out.append(step)
    return series[-1] + np.cumsum(out) if d else np.array(out, float)


def thinned(n: int, most: int | None = MOST) -> np.ndarray:
    """Which of ``n`` rows are predicted: every (n // most)th, ``most`` of them at most; all without ``most``."""
    return np.arange(0, n, max(1, n // most))[:most] if most is not None and n > most else np.arange(n)


def probability(series: np.ndarray) -> float:
    """Of a rise over AHEAD days: the forecast's sum over its scale, through the logistic; 0.5 for too short a series."""
    series = series[~np.isnan(series)]
    if len(series) < FEWEST:
        return 0.5
    total = float(forecast(series).sum())
    scale = max(float(series[-RECENT:].std(ddof=1)) * math.sqrt(AHEAD), 1e-6)
    return 1 / (1 + math.exp(-min(max(total / scale, -700), 700)))


def walk_forward(panel: DataFrame, folds: DataFrame, most: int | None = MOST) -> DataFrame:
    """date_key, company_key, model_rung (0), fold_id, prob_up, predicted_class of a company's test days: ``most`` of them in a
    fold at most, evenly thinned, or all without ``most``. A company is fitted once for a fold, so more days cost no fit."""
    every = folds.select(F.collect_list(F.struct(*folds.columns)).alias("folds"))
    near = lambda f: F.col("trade_date").between(f["train_start"], f["train_end"]) | F.col("trade_date").between(f["test_start"], f["test_end"])
    rows = panel.select("date_key", "company_key", "trade_date", "log_ret_1d").crossJoin(F.broadcast(every)).select("*", F.explode(F.filter("folds", near)).alias("f"))
    rows = rows.select("date_key", "company_key", "trade_date", "log_ret_1d", "f.fold_id", F.col("trade_date").between(F.col("f.test_start"), F.col("f.test_end")).alias("test"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("trade_date")
        test = part[part["test"]]
        test = test.iloc[thinned(len(test), most)]
        p = round(probability(part[~part["test"]]["log_ret_1d"].to_numpy(float)), 5)
        return pd.DataFrame({"date_key": test["date_key"], "company_key": test["company_key"], "model_rung": 0, "fold_id": test["fold_id"], "prob_up": p, "predicted_class": int(p > 0.5)})

    return rows.groupBy("company_key", "fold_id").applyInPandas(one, "date_key string, company_key string, model_rung long, fold_id string, prob_up double, predicted_class long")
