"""Sampling and inference. Every draw hangs on a stable key, so it is the same in any engine and on any cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.stats import stable_key, stable_keys


def hashed_order(*parts: Column) -> Column:
    return stable_key(*parts)


def cluster_bootstrap(rows: DataFrame, scope: list[str], cluster: str, y: Column, replicates: int, seed: str = "b") -> DataFrame:
    """``estimate`` (mean of ``y``) and its 2.5 and 97.5 % quantiles over ``replicates`` draws of the clusters with replacement.

    Rows are summed to clusters first. A draw names a cluster by its rank in the scope, so ``replicates`` times the clusters of a
    scope meet the cluster sums on an equal key; nothing else is replicated.
    """
    sums = rows.groupBy(*scope, cluster).agg(F.sum(y).alias("y"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*scope)
    ranked = sums.withColumn("rank", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("many", F.count(F.lit(1)).over(w))
    slots = ranked.select(*scope, "many", F.col("rank").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = slots.withColumn("rank", F.pmod(stable_key(F.lit(seed), *[F.col(c) for c in scope], F.col("replicate"), F.col("slot")), F.col("many")).cast("int"))
    means = drawn.join(ranked.select(*scope, "rank", "y", "n"), [*scope, "rank"]).groupBy(*scope, "replicate").agg((F.sum("y") / F.sum("n")).alias("m"))
    bounds = means.groupBy(*scope).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return sums.groupBy(*scope).agg((F.sum("y") / F.sum("n")).alias("estimate"), F.count(F.lit(1)).alias("clusters")).join(bounds, scope)


def bootstrap_p(rows: DataFrame, unit: str, y: Column, replicates: int, seed: str = "p") -> DataFrame:
    """The basic bootstrap's one-sided p of a mean above zero: (1 + draws of at least twice the observed mean) / (replicates + 1)."""
    sums = rows.groupBy(unit).agg(F.avg(y).alias("y"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(unit)) - 1)  # units are few: clusters, not rows
    many, observed = ranked.agg(F.count(F.lit(1)), F.avg("y")).first()
    slots = ranked.select(F.col("rank").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = slots.withColumn("rank", F.pmod(stable_key(F.lit(seed), F.col("replicate"), F.col("slot")), F.lit(many)).cast("int"))
    means = drawn.join(ranked.select("rank", "y"), "rank").groupBy("replicate").agg(F.avg("y").alias("m"))
    return means.agg(F.lit(observed).alias("observed"), ((1 + F.count_if(F.col("m") >= 2 * observed)) / (replicates + 1)).alias("p"))


#: Rows of a stratum up to which a task deals its labels out by itself, and about the rows of a group of strata; replicates are split CHUNKS ways.
HELD_ROWS, GROUP_ROWS, CHUNKS = 2_000_000, 200_000, 8


def _dealt_in_tasks(at: DataFrame, stratum: list[str], replicates: int, seed: str, groups: int) -> DataFrame:
    """``replicate`` and the sums and counts of ``y`` by dealt label, of strata that a task can hold: only sums leave it."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(code=rows.groupby(stratum, dropna=False).ngroup()).sort_values(["code", "k"])
        code, names, y = rows["code"].to_numpy(), [x.encode() for x in rows["name"]], rows["y"].to_numpy(float)
        one, other = (rows["label"] == True).to_numpy(bool), (rows["label"] == False).to_numpy(bool)  # noqa: E712 - null is neither
        out = []
        for r in range(rows["chunk"].iloc[0] + 1, replicates + 1, CHUNKS):
            given = y[np.lexsort((stable_keys(f"{seed}|{r}|", names), code))]
            known = ~np.isnan(given)
            yes, no = given[one & known], given[other & known]
            out.append((r, yes.sum(), len(yes), no.sum(), len(no)))
        return pd.DataFrame(out, columns=["replicate", "s1", "n1", "s0", "n0"])

    part = F.pmod(F.xxhash64(*stratum), F.lit(groups)).alias("part")
    copies = at.select(part, *stratum, "k", "name", "label", F.col("y").cast("double").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("chunk"))
    return copies.groupBy("part", "chunk").applyInPandas(deal, "replicate int, s1 double, n1 long, s0 double, n0 long")


def stratified_permutation(rows: DataFrame, key: str, stratum: list[str], label: str, y: str, replicates: int, seed: str = "s") -> DataFrame:
    """Observed difference of the label's means, and the share of permutations within strata that reach it.

    A permutation deals the stratum's labels out by the order of a hash: row k of the identity order takes the label of row k of the
    hashed order. Strata of up to HELD_ROWS rows are dealt in tasks, from which only sums come; a larger one is sorted by Spark, a window
    group a replicate, and meets its labels in a join that is never broadcast.
    """
    base = rows.select(key, *stratum, label, F.col(y).alias("y"))
    own = Window.partitionBy(*stratum)
    at = base.select(*stratum, F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(label).alias("label"), "y", F.row_number().over(own.orderBy(key)).alias("k"), F.count(F.lit(1)).over(own).alias("rows"))
    sizes = base.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n"))
    many, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    sums = _dealt_in_tasks(at.where(F.col("rows") <= HELD_ROWS), stratum, replicates, seed, max(1, -(-many // GROUP_ROWS)))
    if largest > HELD_ROWS:
        wide = at.where(F.col("rows") > HELD_ROWS)
        copies = wide.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        dealt = copies.withColumn("place", F.row_number().over(Window.partitionBy("replicate", *stratum).orderBy(stable_key(F.lit(seed), F.col("replicate"), F.col("key")), "key"))).drop("label")
        labels = wide.select(*stratum, F.col("k").alias("place"), F.col("label").alias("given")).hint("merge")
        yes, no = F.when(F.col("given"), F.col("y")), F.when(~F.col("given"), F.col("y"))
        sums = sums.unionByName(dealt.join(labels, [*stratum, "place"]).groupBy("replicate").agg(F.sum(yes).alias("s1"), F.count(yes).alias("n1"), F.sum(no).alias("s0"), F.count(no).alias("n0")))
    mean = lambda k: F.try_divide(F.sum(f"s{k}"), F.sum(f"n{k}"))
    null = sums.groupBy("replicate").agg((mean(1) - mean(0)).alias("d"))
    seen = base.agg((F.avg(F.when(F.col(label), F.col("y"))) - F.avg(F.when(~F.col(label), F.col("y")))).alias("observed"))
    return null.crossJoin(F.broadcast(seen)).groupBy("observed").agg(((1 + F.count_if(F.col("d") >= F.col("observed"))) / (replicates + 1)).alias("p"), F.median("d").alias("null_median"))  # one row


def matched_set_permutation(sets: DataFrame, matched: str, unit: str, treated: str, y: str, replicates: int, seed: str = "m") -> DataFrame:
    """Mean treated-minus-control difference over matched sets; in a replicate each set's treated label falls on a unit by hash."""
    w = Window.partitionBy(matched)
    rows = sets.select(matched, unit, treated, F.col(y).alias("y")).withColumn("many", F.count(F.lit(1)).over(w)).withColumn("total", F.sum("y").over(w))
    gap = lambda own: F.col(own) - (F.col("total") - F.col(own)) / (F.col("many") - 1)
    seen = rows.where(F.col(treated)).agg(F.avg(gap("y")).alias("observed"))

    def firsts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a batch, the first unit of each set in each replicate."""
        for part in parts:
            for chunk, own in part.sort_values("unit").groupby("chunk"):
                code, names = pd.factorize(own["set"])[0], [x.encode() for x in own["name"]]
                for r in range(chunk + 1, replicates + 1, CHUNKS):
                    h = stable_keys(f"{seed}|{r}|", names)
                    order = np.lexsort((h, code))
                    at = order[np.flatnonzero(np.diff(code[order], prepend=-1))]
                    yield own.iloc[at].assign(replicate=r, h=h[at])[["replicate", "set", "h", "unit", "gap"]]

    kinds = dict(rows.dtypes)
    copies = rows.select(F.col(matched).alias("set"), F.col(unit).alias("unit"), F.col(unit).cast("string").alias("name"), gap("y").cast("double").alias("gap"), F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("chunk"))
    found = copies.repartition(8 * CHUNKS, "set", "chunk").mapInPandas(firsts, f"replicate int, set {kinds[matched]}, h long, unit {kinds[unit]}, gap double")
    chosen = found.groupBy("replicate", "set").agg(F.min_by("gap", F.struct("h", "unit")).alias("gap"))  # a row a batch and set comes here
    null = chosen.groupBy("replicate").agg(F.avg("gap").alias("d"))
    return null.crossJoin(F.broadcast(seen)).groupBy("observed").agg(((1 + F.count_if(F.col("d") >= F.col("observed"))) / (replicates + 1)).alias("p"))  # one row


def stratified_sample(rows: DataFrame, key: str, stratum: str, quotas: dict[str, int], seed: str = "q") -> DataFrame:
    """Up to a stratum's quota of rows in hashed order, with the probability of inclusion ``min(quota, n) / n``."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    w = Window.partitionBy(stratum)
    ranked = rows.withColumn("quota", F.coalesce(F.element_at(quota, F.col(stratum)), F.lit(0))).withColumn("r", F.row_number().over(w.orderBy(stable_key(F.lit(seed), F.col(key)), key))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("r") <= F.col("quota")).withColumn("p", F.least("quota", "n") / F.col("n")).drop("quota", "r", "n")


def bucket_sample(rows: DataFrame, key: str, buckets: dict[str, Column], each: int, seed: str = "u") -> DataFrame:
    """``each`` rows of every bucket without replacement: a row counts for the first bucket that it fits."""
    bucket = None
    for name, mask in buckets.items():
        bucket = F.when(mask, name) if bucket is None else bucket.when(mask, name)
    own = rows.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    return own.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(stable_key(F.lit(seed), F.col(key)), key))).where(F.col("r") <= each).drop("r")


def top_up(rows: DataFrame, key: str, group: str, eligible: Column, target: int, seed: str = "t") -> DataFrame:
    """For groups short of ``target`` eligible rows that are drawn already (``drawn``), more rows: the deficit over the eligible rate."""
    w = Window.partitionBy(group)
    state = rows.withColumn("have", F.sum(F.when(F.col("drawn") & eligible, 1).otherwise(0)).over(w)).withColumn("seen", F.sum(F.when(F.col("drawn"), 1).otherwise(0)).over(w))
    rate = F.greatest(F.col("have") / F.greatest("seen", F.lit(1)), F.lit(0.05))
    wanted = F.ceil(F.greatest(F.lit(target) - F.col("have"), F.lit(0)) / rate)
    rest = state.withColumn("wanted", wanted).where(~F.col("drawn"))
    return rest.withColumn("r", F.row_number().over(w.orderBy(stable_key(F.lit(seed), F.col(key)), key))).where(F.col("r") <= F.col("wanted")).drop("have", "seen", "wanted", "r")


def thread_sample(rows: DataFrame, thread: str, stratum: Column, each: int, seed: str = "h") -> DataFrame:
    """``each`` threads of every stratum of thread sizes, with all their rows."""
    threads = rows.groupBy(thread).agg(F.count(F.lit(1)).alias("size")).withColumn("stratum", stratum)
    chosen = threads.withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy(stable_key(F.lit(seed), F.col(thread)), thread))).where(F.col("r") <= each)
    return rows.join(chosen.select(thread, "stratum"), thread)


def redacted(rows: DataFrame, thread: str, turn: str, keep: list[str]) -> DataFrame:
    """Rows with thread and node ids relabelled from 1 in hashed order, parents alike."""
    labels = rows.select(thread).distinct().withColumn("_h", stable_key(F.lit("r"), F.col(thread)))
    numbered = labels.withColumn("thread_label", F.row_number().over(Window.orderBy("_h", thread))).drop("_h")  # a sample's threads, not a corpus's
    node = F.row_number().over(Window.partitionBy(thread).orderBy(turn))
    return rows.join(numbered, thread).withColumn("node_label", node).withColumn("parent_label", F.when(F.col(turn) > 0, node - 1)).select("thread_label", "node_label", "parent_label", *keep)


def grouped_folds(rows: DataFrame, group: str, folds: int, seed: str = "f") -> DataFrame:
    """Whole groups dealt to folds in snake order of size, ties by hash: folds differ little in rows."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), stable_key(F.lit(seed), F.col(group)), group)) - 1)  # groups are few
    lap, at = F.floor(F.col("r") / folds), F.col("r") % folds
    return sizes.select(group, "n", F.when(lap % 2 == 0, at).otherwise(folds - 1 - at).cast("int").alias("fold"))


def macro_f1(counts: DataFrame, scope: list[str]) -> DataFrame:
    """The mean of the classes' F1 from ``tp``, ``fp`` and ``fn``; a class without any has zero."""
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return counts.groupBy(*scope).agg(F.avg(f1).alias("macro_f1"))


def threshold_grid(rows: DataFrame, score: str, truth: Column, grid: list[float]) -> DataFrame:
    """F1 of a positive class at each threshold; the best is the one nearest 0.5 of those with the highest, then the lower."""
    hits = [F.struct(F.lit(g).alias("threshold"), F.count_if((F.col(score) >= g) & truth).alias("tp"), F.count_if((F.col(score) >= g) & ~truth).alias("fp"), F.count_if((F.col(score) < g) & truth).alias("fn")) for g in grid]
    long = rows.agg(F.array(*hits).alias("h")).select(F.explode("h").alias("h")).select("h.*")
    scored = long.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))
    return scored.withColumn("best", F.row_number().over(Window.orderBy(F.desc("f1"), F.abs(F.col("threshold") - 0.5), "threshold")) == 1)  # one row a threshold


def mahalanobis_caliper(rows: DataFrame, key: str, case: str, broker: Column, control: Column, x: str, y: str, ratio: int = 3, caliper: float = 0.20) -> DataFrame:
    """Brokers with their nearest controls inside the calipers, without replacement, greedily in the brokers' order, case by case.

    Greedy matching depends on order, so each case is one group; candidates come from both axes' standardised values.
    """
    w = Window.partitionBy(case)
    z = lambda c: (F.log1p(c) - F.avg(F.log1p(c)).over(w)) / F.stddev_pop(F.log1p(c)).over(w)
    scored = rows.withColumns({"zx": z(x), "zy": z(y)}).select(key, case, broker.alias("broker"), control.alias("control"), "zx", "zy")

    def match(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        points = group[["zx", "zy"]].to_numpy(float)
        inverse = np.linalg.pinv(np.cov(points.T)) if len(group) > 1 else np.zeros((2, 2))
        free = np.flatnonzero(group["control"].to_numpy(bool) & ~group["broker"].to_numpy(bool))
        ids, out = group[key].to_numpy(), []
        for i in np.flatnonzero(group["broker"].to_numpy(bool)):
            gap = points[free] - points[i]
            near = np.flatnonzero((np.abs(gap) <= caliper).all(axis=1))
            far = np.einsum("ij,jk,ik->i", gap[near], inverse, gap[near])
            chosen = near[np.lexsort((ids[free[near]], far))][:ratio]
            out += [(group[case].iloc[0], ids[i], ids[free[j]], k + 1) for k, j in enumerate(chosen)]
            free = np.delete(free, chosen)
        return pd.DataFrame(out, columns=[case, "treated", "matched", "nth"])

    kinds = dict(rows.dtypes)
    return scored.groupBy(case).applyInPandas(match, f"{case} {kinds[case]}, treated {kinds[key]}, matched {kinds[key]}, nth int")
