"""Models of daily series that have no declarative form. A series is a row a day, some thousands at most, so each is one group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _daily(series: DataFrame, name: str, day: str, *values: str) -> DataFrame:
    return series.select(name, F.col(day).cast("date").alias("day"), *[F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)])


def best_cuts(values: np.ndarray, penalty: float, shortest: int) -> tuple[list[int], float]:
    """Places where the mean changes: least squares within segments of ``shortest`` values or more plus ``penalty`` a cut.

    One pass over ends; a start whose cost without a further penalty already exceeds the best of an end is dropped. That is exact but for ends
    nearer than ``shortest`` to the dropping one, where the usual rule, kept here, may lose a start.
    """
    n = len(values)
    if n < 2 * shortest:
        return [], math.nan
    s, q = np.r_[0.0, np.cumsum(values)], np.r_[0.0, np.cumsum(values * values)]
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    alive = np.array([0])
    for end in range(shortest, n + 1):
        near = alive > end - shortest
        at = alive[~near]
        cost = best[at] + q[end] - q[at] - (s[end] - s[at]) ** 2 / (end - at)
        k = int(np.argmin(cost))
        best[end], back[end] = cost[k] + penalty, at[k]
        alive = np.r_[at[cost <= best[end]], alive[near], end]
    cuts, end = [], n
    while back[end]:
        end = int(back[end])
        cuts.append(end)
    return cuts[::-1], float(best[n])


def change_points(series: DataFrame, name: str, day: str, value: str, penalty: float, shortest: int = 7) -> DataFrame:
    """First days of new segments of each series; ``penalty`` is in units of the series' variance, a flat series has none."""
    kind = dict(series.dtypes)[name]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        v = group["v0"].to_numpy(float)
        cuts, _ = best_cuts(v, penalty * v.var(), shortest) if v.var() > 0 else ([], 0.0)
        if not cuts:
            return pd.DataFrame()
        ends = [*cuts[1:], len(v)]
        return pd.DataFrame({name: [group[name].iloc[0]] * len(cuts), "day": group["day"].iloc[cuts].tolist(), "mean": [float(v[a:b].mean()) for a, b in zip(cuts, ends, strict=True)]})

    return _daily(series, name, day, value).groupBy(name).applyInPandas(fit, f"{name} {kind}, day date, mean double")


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 1000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def f_tail(f: float, d1: int, d2: int) -> float:
    return beta_share(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def _lags(v: np.ndarray, lag: int) -> np.ndarray:
    return np.stack([v[lag - k : len(v) - k] for k in range(1, lag + 1)], axis=1)


def _left(x: np.ndarray, y: np.ndarray) -> float:
    r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return float(r @ r)


def whitened(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both series differenced, then freed of the target's first-order autoregression."""
    y, x = np.diff(y), np.diff(x)
    base = float(y[:-1] @ y[:-1])
    phi = float(y[:-1] @ y[1:]) / base if base else 0.0
    return y[1:] - phi * y[:-1], x[1:] - phi * x[:-1]


def lag_test(series: DataFrame, name: str, day: str, target: str, predictor: str, longest: int = 7, whiten: bool = True) -> DataFrame:
    """F test, for 1 to ``longest`` lags, of a predictor's lags beside the target's own; series too short for it give no rows."""
    kind = dict(series.dtypes)[name]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        y, x = group["v0"].to_numpy(float), group["v1"].to_numpy(float)
        if whiten and len(y) >= 5:
            y, x = whitened(y, x)
        out = []
        for lag in range(1, longest + 1) if len(y) > longest + 3 else ():
            own = np.column_stack([np.ones(len(y) - lag), _lags(y, lag)])
            both = np.column_stack([own, _lags(x, lag)])
            free = max(len(own) - both.shape[1], 1)
            narrow, wide = _left(own, y[lag:]), _left(both, y[lag:])
            f = max((narrow - wide) / lag / (wide / free), 0.0) if wide else 0.0
            out.append((group[name].iloc[0], lag, len(own), f, f_tail(f, lag, free)))
        return pd.DataFrame(out, columns=[name, "lag", "n", "f", "p"] if out else None)

    return _daily(series, name, day, target, predictor).groupBy(name).applyInPandas(fit, f"{name} {kind}, lag int, n long, f double, p double")


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, mix: float, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise half the mean squared error plus ``alpha`` times the mixed penalty, coordinate by coordinate."""
    mx, my = x.mean(axis=0), y.mean()
    x, rest = x - mx, y - my
    w, n = np.zeros(x.shape[1]), len(y)
    size = (x * x).sum(axis=0) / n
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            if size[j] == 0:
                continue
            pull = x[:, j] @ rest / n + size[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha * mix, 0.0) / (size[j] + alpha * (1 - mix))
            rest = rest - x[:, j] * (new - w[j])
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-9:
            break
    return w, float(my - mx @ w)


def lag_forecasts(series: DataFrame, name: str, day: str, value: str, train: int = 28, alpha: float = 0.1, mix: float = 0.5) -> DataFrame:
    """One-day forecasts at rolling origins from the values 1 and 7 days before: least squares, elastic net and the seasonal value."""
    kind = dict(series.dtypes)[name]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        v, days = group["v0"].to_numpy(float), group["day"].tolist()
        out = []
        for i in range(max(train, 9), len(v)):
            x, y, now = np.stack([v[6 : i - 1], v[: i - 7]], axis=1), v[7:i], np.array([v[i - 1], v[i - 7]])
            b = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
            w, c = elastic_net(x, y, alpha, mix)
            out.append((group[name].iloc[0], days[i], v[i], float(b[0] + now @ b[1:]), float(c + now @ w), float(now[1])))
        return pd.DataFrame(out, columns=[name, "day", "actual", "autoregressive", "elastic_net", "seasonal"] if out else None)

    return _daily(series, name, day, value).groupBy(name).applyInPandas(fit, f"{name} {kind}, day date, actual double, autoregressive double, elastic_net double, seasonal double")
