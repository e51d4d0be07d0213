"""Daily series: baseline-normalised rates, prewhitened lag correlation, rolling origins, window stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalised(series: DataFrame, group: str, day: str, n: str, cap: int) -> DataFrame:
    """Rate per 10,000 of the day's total; a day on which any term reaches ``cap`` has no denominator."""
    base = series.groupBy(day).agg(F.when(F.max(n) < cap, F.sum(n)).alias("_base"))
    return series.join(base, day).withColumn("per_10k", F.round(10000.0 * F.col(n) / F.col("_base"), 4)).drop("_base")


def lag_correlation(series: DataFrame, day: str, a: str, b: str, lags: int) -> DataFrame:
    """Correlation of prewhitened first differences at lags -k .. k. A daily series is short: one window, one task."""
    w = Window.orderBy(day)
    d = series.select(day, (F.col(a) - F.lag(a).over(w)).alias("x"), (F.col(b) - F.lag(b).over(w)).alias("y")).where("x is not null and y is not null")
    e = d.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).where("px is not null")
    phi = e.agg((F.sum(F.col("x") * F.col("px")) / F.sum(F.col("px") * F.col("px"))).alias("phi"))
    r = e.crossJoin(F.broadcast(phi)).select(F.row_number().over(w).alias("i"), (F.col("x") - F.col("phi") * F.col("px")).alias("u"), (F.col("y") - F.col("phi") * F.col("py")).alias("v"))
    grid = r.select("i", "u", F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"))
    pairs = grid.join(r.select(F.col("i").alias("j"), "v"), F.col("j") == F.col("i") - F.col("lag"))
    return pairs.groupBy("lag").agg(F.when(F.count(F.lit(1)) >= 3, F.corr("u", "v")).alias("r"), F.count(F.lit(1)).alias("n"))


def rolling_origins(series: DataFrame, day: str, horizons: list[int], train: int = 28) -> DataFrame:
    """Cutoff and target of every rolling-origin split with at least ``train`` days before."""
    numbered = series.select(day).distinct().withColumn("i", F.row_number().over(Window.orderBy(day)))
    cut = numbered.where(F.col("i") >= train).select(F.col("i"), F.col(day).alias("cutoff"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    return cut.join(numbered.select(F.col("i").alias("_j"), F.col(day).alias("target")), F.col("_j") == F.col("i") + F.col("horizon")).select("cutoff", "horizon", "target", F.col("i").alias("train_days"))


def overlap_factors(windows: DataFrame, window: str, keys: list[str], value: str) -> DataFrame:
    """Median positive ratio of consecutive windows over their overlap, and the number of pairs."""
    a, b = windows.alias("a"), windows.alias("b")
    met = F.col(f"b.{window}") == F.col(f"a.{window}") + 1
    for k in keys:
        met = met & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, met).where((F.col(f"a.{value}") > 0) & (F.col(f"b.{value}") > 0))
    return pairs.groupBy(F.col(f"b.{window}").alias(window)).agg(F.percentile(F.col(f"a.{value}") / F.col(f"b.{value}"), F.lit(0.5)).alias("factor"), F.count(F.lit(1)).alias("pairs"))


def rolling_naive(series: DataFrame, day: str, value: str, horizon: int, season: int = 7) -> DataFrame:
    """Seasonal-naive forecast of each day and its absolute error."""
    w = Window.orderBy(day)
    lag = -(-horizon // season) * season
    return series.withColumn("forecast", F.lag(value, lag).over(w)).withColumn("error", F.abs(F.col(value) - F.col("forecast")))


def forecast_errors(series: DataFrame, day: str, value: str, horizons: list[int], train: int, season: int = 7) -> DataFrame:
    """MAE and RMSE of the seasonal naive and the last value at rolling origins, for each horizon. ``day`` rows are whole days, once each;
    the forecast for a target is the value a season before it if that lies at or before the origin, else the last one known."""
    s = series.select(F.col(day).alias("day"), F.col(value).cast("double").alias("v")).withColumn("i", F.row_number().over(Window.orderBy(day)))  # one row a day
    h = F.explode(F.array(*[F.lit(x) for x in horizons])).alias("horizon")
    origins = s.where(F.col("i") >= train).select(F.col("day").alias("origin"), F.col("v").alias("last"), h)
    target = s.select(F.col("day").alias("target"), F.col("v").alias("actual"))
    known = s.select(F.date_add("day", season).alias("target"), F.col("day").alias("base"), F.col("v").alias("seasonal"))
    met = origins.withColumn("target", F.date_add("origin", F.col("horizon"))).join(target, "target").join(known, "target", "left")
    naive = F.when(F.col("base") <= F.col("origin"), F.col("seasonal")).otherwise(F.col("last"))
    err = lambda f: (F.avg(F.abs(F.col("actual") - f)), F.sqrt(F.avg((F.col("actual") - f) * (F.col("actual") - f))))
    (a, b), (c, d) = err(naive), err(F.col("last"))
    return met.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), a.alias("naive_mae"), b.alias("naive_rmse"), c.alias("last_mae"), d.alias("last_rmse"))


def placebo_steps(series: DataFrame, day: str, value: str, width: int) -> DataFrame:
    """For every day as if it were the event: mean of ``width`` days from it minus mean of as many before, where both are complete."""
    s = series.select(F.col(day).alias("day"), F.col(value).cast("double").alias("v"))
    spread = s.select(F.explode(F.sequence(F.date_sub("day", width - 1), F.date_add("day", width))).alias("event"), "day", "v")
    after = F.col("day") >= F.col("event")
    g = spread.groupBy("event").agg(F.avg(F.when(after, F.col("v"))).alias("post"), F.avg(F.when(~after, F.col("v"))).alias("pre"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") == 2 * width).select("event", (F.col("post") - F.col("pre")).alias("step"))


def series_audit(rows: DataFrame, name: str, day: str, value: str) -> DataFrame:
    """Days, repeated days, days missing between the first and the last, and the share of zero values, for each series."""
    g = rows.groupBy(name).agg(F.count(F.lit(1)).alias("points"), F.countDistinct(day).alias("days"), (F.datediff(F.max(day), F.min(day)) + 1).alias("span"), F.avg((F.col(value) == 0).cast("double")).alias("zero_share"))
    return g.select(name, "points", (F.col("points") - F.col("days")).alias("repeated"), (F.col("span") - F.col("days")).alias("missing"), "zero_share")


def segmented_trend(series: DataFrame, name: str, day: str, value: str, event: str, lags: int = 7) -> DataFrame:
    """Interrupted time series by name: level and slope before and after the event day, day-of-week terms, Newey-West errors.

    A series is a row a day, hundreds at most, so each is one group; the regression itself has no declarative form.
    """
    import numpy as np
    import pandas as pd

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        when = pd.to_datetime(group["day"])
        at = (when - pd.Timestamp(event)).dt.days.to_numpy(float)
        post = (at >= 0).astype(float)
        week = np.stack([(when.dt.dayofweek == k).to_numpy(float) for k in range(1, 7)], axis=1)
        x = np.column_stack([np.ones(len(at)), at - at.min(), post, post * at, week])
        y = group["v"].to_numpy(float)
        inverse = np.linalg.pinv(x.T @ x)
        beta = inverse @ x.T @ y
        u = x * (y - x @ beta)[:, None]
        meat = u.T @ u
        for lag in range(1, min(lags, len(y) - 1) + 1):
            cross = u[lag:].T @ u[:-lag]
            meat += (1 - lag / (lags + 1)) * (cross + cross.T)
        error = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
        terms = ["intercept", "trend", "level", "slope"]
        return pd.DataFrame({name: group[name].iloc[0], "term": terms, "estimate": beta[:4], "error": error[:4], "days": len(y)})

    rows = series.select(name, F.col(day).cast("date").alias("day"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(name).applyInPandas(fit, f"{name} {dict(rows.dtypes)[name]}, term string, estimate double, error double, days long")
