"""Cluster bootstraps of group differences and of macro-F1, and power of a mean. Rows are summed to clusters before any draw."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.stats import stable_key


def _draws(ranked: DataFrame, scope: list[str], replicates: int, seed: str) -> DataFrame:
    """``replicate`` and ``rank`` of a cluster drawn for each of the scope's clusters; ``ranked`` has ``rank`` and ``many``."""
    slots = ranked.select(*scope, "many", F.col("rank").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    at = F.pmod(stable_key(F.lit(seed), *[F.col(c) for c in scope], F.col("replicate"), F.col("slot")), F.col("many"))
    return slots.select(*scope, "replicate", at.cast("int").alias("rank"))


def thread_bootstrap_difference(rows: DataFrame, case: str, later: str, earlier: str, thread: str, author: str, y: Column, replicates: int, balanced: bool = True, seed: str = "h") -> DataFrame:
    """``observed`` difference of a share between two cases, its bootstrap quantiles and the one-sided basic-bootstrap ``p``.

    Threads are drawn with replacement within each case. Balanced, a share is the mean over authors of the author's mean; an author in a
    thread drawn twice counts as two, so a thread's authors and the sum of their means say all that a draw needs. Rows without an author
    then stand aside. Unbalanced, every row counts once.
    """
    base = rows.where(F.col(case).isin(later, earlier)).select(F.col(case).alias("case"), F.col(thread).alias("thread"), F.col(author).cast("string").alias("author"), y.cast("double").alias("y"))
    if balanced:
        base = base.where(F.coalesce(F.col("author") != "", F.lit(False)))
        units, whole = base.groupBy("case", "thread", "author").agg(F.avg("y").alias("y")), base.groupBy("case", "author").agg(F.avg("y").alias("y"))
    else:
        units = whole = base
    sums = units.groupBy("case", "thread").agg(F.sum("y").alias("y"), F.count("y").alias("n"))
    w = Window.partitionBy("case")
    ranked = sums.withColumn("rank", F.row_number().over(w.orderBy("thread")) - 1).withColumn("many", F.count(F.lit(1)).over(w))  # a row a thread
    side = lambda v: F.sum(F.when(F.col("case") == later, v)) - F.sum(F.when(F.col("case") == earlier, v))
    shares = _draws(ranked, ["case"], replicates, seed).join(ranked.select("case", "rank", "y", "n"), ["case", "rank"]).groupBy("replicate", "case").agg((F.sum("y") / F.sum("n")).alias("m"))
    boot = shares.groupBy("replicate").agg(side(F.col("m")).alias("d"))
    seen = whole.groupBy("case").agg(F.avg("y").alias("m")).agg(side(F.col("m")).alias("observed"))
    at = lambda q: F.percentile("d", q)
    p = (1 + F.count_if(F.col("d") >= 2 * F.col("observed"))) / (replicates + 1)
    return boot.crossJoin(F.broadcast(seen)).groupBy("observed").agg(at(0.025).alias("low"), at(0.5).alias("median"), at(0.975).alias("high"), p.alias("p"))  # one row


def macro_f1_bootstrap(rows: DataFrame, cluster: str, actual: Column, predicted: Column, replicates: int, seed: str = "c") -> DataFrame:
    """Macro-F1 and its quantiles over draws of clusters; a class that a draw holds neither as actual nor as predicted isn't averaged."""
    pairs = rows.select(F.col(cluster).alias("cluster"), actual.cast("string").alias("actual"), predicted.cast("string").alias("predicted"))
    hit = F.col("actual") == F.col("predicted")
    one = lambda c, tp, fp, fn: F.struct(F.col(c).alias("label"), tp.cast("int").alias("tp"), fp.cast("int").alias("fp"), fn.cast("int").alias("fn"))
    no = F.lit(False)
    seen = F.when(hit, F.array(one("actual", hit, no, no))).otherwise(F.array(one("actual", no, no, ~hit), one("predicted", no, ~hit, no)))
    counts = pairs.select("cluster", F.inline(seen)).groupBy("cluster", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    clusters = pairs.select("cluster").distinct()
    ranked = clusters.withColumn("rank", F.row_number().over(Window.orderBy("cluster")) - 1).withColumn("many", F.count(F.lit(1)).over(Window.partitionBy()))  # clusters, not rows
    f1 = 2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    drawn = _draws(ranked, [], replicates, seed).join(ranked.select("cluster", "rank"), "rank").join(counts, "cluster")
    boot = drawn.groupBy("replicate", "label").agg(f1.alias("f1")).groupBy("replicate").agg(F.avg("f1").alias("m"))
    whole = counts.groupBy("label").agg(f1.alias("f1")).agg(F.avg("f1").alias("macro_f1"))
    return boot.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.5).alias("median"), F.percentile("m", 0.975).alias("high")).crossJoin(F.broadcast(whole)).select("macro_f1", "low", "median", "high")  # one row


def power_diagnostic(rows: DataFrame, group: str, y: Column, effect: float, alpha: float = 0.05, power: float = 0.8, two_sided: bool = False) -> DataFrame:
    """Standard error, smallest detectable effect and power at ``effect`` of each group's mean. A group is one row when the normal
    distribution, which has no built-in, is asked."""
    normal = NormalDist()
    critical = normal.inv_cdf(1 - alpha / (2 if two_sided else 1))

    @F.pandas_udf("double")
    def reached(error: pd.Series) -> pd.Series:
        upper = error.map(lambda e: 1 - normal.cdf(critical - effect / e))
        return upper + error.map(lambda e: normal.cdf(-critical - effect / e)) if two_sided else upper

    g = rows.groupBy(group).agg(F.count(y).alias("n"), F.stddev_samp(y).alias("sd")).where("sd > 0")
    e = g.withColumn("error", F.col("sd") / F.sqrt("n"))
    return e.select(group, "n", "sd", "error", ((critical + normal.inv_cdf(power)) * F.col("error")).alias("mde"), reached("error").alias("power"))
