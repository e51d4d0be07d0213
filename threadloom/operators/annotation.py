"""Manual decisions on records: overrides, masks that heed them, merged coders, a threshold for each label, topics laid side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERRIDES = ("english", "non_english", "exclude")


def apply_overrides(rows: DataFrame, overrides: DataFrame, thing: str, key: str, prefix: Column) -> DataFrame:
    """Rows with ``override``: the decision for the key as it stands, else with its prefix, else without it.

    ``overrides`` has ``thing``, ``key`` and ``value``; blank parts are passed over, an unknown value is an error, and of repeated keys the greatest
    value holds. The spellings of one row are settled by rank after one equi-join, so the rows are read once.
    """
    value = F.lower(F.trim("value"))
    known = F.when(value.isin(*OVERRIDES), value).otherwise(F.raise_error(F.concat(F.lit("unknown override: "), value)))
    table = overrides.where((F.trim("thing") != "") & (F.trim("key") != "") & (value != "")).groupBy(F.trim("thing").alias("_thing"), F.trim("key").alias("_key")).agg(F.max(known).alias("_value"))
    own = F.col(key)
    bare = F.when(F.startswith(own, prefix), F.substr(own, F.length(prefix) + 1))
    full = F.when(~F.startswith(own, prefix), F.concat(prefix, own))
    spelt = rows.select(thing, key).distinct().select(thing, key, F.posexplode(F.array(own, full, bare)).alias("_rank", "_key"))
    met = spelt.join(table, (spelt[thing] == table["_thing"]) & (spelt["_key"] == table["_key"]))
    chosen = met.groupBy(F.col(thing).alias("_t"), F.col(key).alias("_k")).agg(F.min_by("_value", "_rank").alias("override"))
    return rows.join(chosen, (F.col(thing) == F.col("_t")) & (F.col(key) == F.col("_k")), "left").drop("_t", "_k")


def eligibility(status: Column, english: Column, substantive: Column, override: Column) -> dict[str, Column]:
    """Review, strict and inclusive masks. A decision to exclude beats all; one for the language beats the detector's doubt, not its other objections."""
    barred = F.coalesce(override.isin("exclude", "non_english"), F.lit(False))
    unsure = status == "language_uncertain"
    review = substantive & unsure
    strict = substantive & (status == "eligible") & english & ~barred
    vouched = F.coalesce(override == "english", F.lit(False)) & substantive & (unsure | (status == "eligible"))
    return {"review": review, "strict": strict, "inclusive": (strict | review | vouched) & ~barred}


def merge_coders(a: str, b: str, settled: str) -> Column:
    """A field's adjudicated value: both coders' where they agree, else what was settled before."""
    return F.when(F.col(a).eqNullSafe(F.col(b)), F.col(a)).otherwise(F.col(settled))


def merge_label_sets(a: Column, b: Column, settled: Column, labels: list[str]) -> Column:
    """Label by label: in if both coders have it, out if neither has, else as settled before; in the order of ``labels``."""
    have = lambda s, x: F.coalesce(F.array_contains(s, x), F.lit(False))
    keep = lambda x: F.when(have(a, x) == have(b, x), have(a, x)).otherwise(have(settled, x))
    return F.filter(F.array(*[F.lit(x) for x in labels]), keep)


def label_thresholds(rows: DataFrame, scores: dict[str, tuple[Column, Column]], grid: list[float]) -> DataFrame:
    """For each label (score, truth) the threshold of best F1, ties to the nearest to one half, then the lower. One pass counts all thresholds."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("label"), s.cast("double").alias("s"), y.alias("y")) for k, (s, y) in scores.items()])))
    counts = []
    for k, cut in enumerate(grid):
        over = F.col("s") >= cut
        counts += [F.count_if(over & F.col("y")).alias(f"tp{k}"), F.count_if(over & ~F.col("y")).alias(f"fp{k}"), F.count_if(~over & F.col("y")).alias(f"fn{k}")]
    wide = long.groupBy("label").agg(*counts)
    one = [F.struct(F.lit(cut).alias("threshold"), *[F.col(f"{c}{k}").alias(c) for c in ("tp", "fp", "fn")]) for k, cut in enumerate(grid)]
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    tall = wide.select("label", F.inline(F.array(*one))).withColumn("f1", f1)
    return tall.groupBy("label").agg(F.max_by(F.struct("threshold", "tp", "fp", "fn", "f1"), F.struct("f1", -F.abs(F.col("threshold") - 0.5), -F.col("threshold"))).alias("x")).select("label", "x.*")


def assignment(scores: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of the one-to-one assignment with the greatest total, by shortest augmenting paths over reduced costs."""
    flip = scores.shape[0] > scores.shape[1]
    cost = -(scores.T if flip else scores)
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        dist, came, done = cost[row] - u[row] - v, np.full(m, -1), np.zeros(m, dtype=bool)
        while True:
            j = int(np.argmin(np.where(done, np.inf, dist)))
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            other = dist[j] + cost[i] - u[i] - v
            nearer = ~done & (other < dist)
            dist[nearer], came[nearer] = other[nearer], j
        end, low = j, dist[j]
        for k in np.flatnonzero(done & (owner >= 0)):
            u[owner[k]] += low - dist[k]
            v[k] -= low - dist[k]
        u[row] += low
        while came[end] >= 0:
            owner[end] = owner[came[end]]
            end = int(came[end])
        owner[end] = row
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def topic_assignment(left: DataFrame, right: DataFrame, topic: str, terms: str) -> DataFrame:
    """Topics of two models paired one to one by greatest total Jaccard of their terms. A model has tens of topics: one group."""
    one = lambda df: df.select(F.lit(0).alias("all"), F.col(topic).cast("string").alias("topic"), F.col(terms).alias("terms"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("topic"), b.sort_values("topic")
        x, y = [set(s) for s in a["terms"]], [set(s) for s in b["terms"]]
        j = np.array([[len(p & q) / len(p | q) if p | q else 1.0 for q in y] for p in x]).reshape(len(x), len(y))
        found = assignment(j) if j.size else []
        return pd.DataFrame([(a["topic"].iloc[i], b["topic"].iloc[k], float(j[i, k])) for i, k in found], columns=["left", "right", "jaccard"] if found else None)

    return one(left).groupBy("all").cogroup(one(right).groupBy("all")).applyInPandas(pair, "left string, right string, jaccard double")
