"""Aggregates: concentration, balanced and weighted shares, dense timelines, agreement, classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.stats import jensen_shannon, total


def concentration(rows: DataFrame, scope: list[str], entity: str) -> DataFrame:
    """Top-1 and top-10 share and the effective number of entities; rows without an entity are left out before both grains."""
    counts = rows.where(F.col(entity).isNotNull()).groupBy(*scope, entity).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*scope)
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), entity)))
    return ranked.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("entities"),
        F.max("share").alias("top1_share"),
        F.sum(F.when(F.col("rn") <= 10, F.col("share")).otherwise(0.0)).alias("top10_share"),
        (1 / F.sum(F.col("share") * F.col("share"))).alias("effective_n"),
    )


def balanced_share(rows: DataFrame, scope: list[str], author: str, hit: Column) -> DataFrame:
    """The share of hits weighted by document and, beside it, as the mean of the authors' own shares."""
    own = rows.groupBy(*scope, author).agg(F.sum(hit.cast("double")).alias("h"), F.count(F.lit(1)).alias("n"))
    return own.groupBy(*scope).agg((F.sum("h") / F.sum("n")).alias("document_share"), F.avg(F.col("h") / F.col("n")).alias("author_share"), F.count(F.lit(1)).alias("authors"))


def dense_days(rows: DataFrame, day: Column, group: list[str]) -> DataFrame:
    """Counts on every day from a group's first to its last; days without rows are there, with a null count: missing isn't zero."""
    counts = rows.groupBy(*group, day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spans = counts.groupBy(*group).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return spans.join(counts, [*group, "day"], "left")


def support_status(days: DataFrame, group: list[str], least: int = 20) -> DataFrame:
    """missing, thin or supported days, and whether to go weekly: over a third of the group's days are thin or missing."""
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") < least, "thin").otherwise("supported")
    weak = F.avg((F.col("status") != "supported").cast("double")).over(Window.partitionBy(*group))
    return days.withColumn("status", status).withColumn("weekly", weak > 1 / 3)


def weighted_prevalence(rows: DataFrame, scope: list[str], hit: Column, p: Column) -> DataFrame:
    """Inverse-probability-weighted share and Kish's effective size."""
    w = 1 / p
    return rows.groupBy(*scope).agg((F.sum(w * hit.cast("double")) / F.sum(w)).alias("prevalence"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"), F.count(F.lit(1)).alias("n"))


def cohen_kappa(rows: DataFrame, scope: list[str], a: str, b: str) -> DataFrame:
    """Percent agreement and kappa; without variation 1.0 if identical, else 0.0."""
    cells = rows.groupBy(*scope, a, b).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*scope)
    shares = cells.withColumn("t", F.sum("n").over(w)).withColumn("ra", F.sum("n").over(w.partitionBy(*scope, a))).withColumn("rb", F.sum("n").over(Window.partitionBy(*scope, b)))
    left = rows.groupBy(*scope, F.col(a).alias("c")).agg(F.count(F.lit(1)).alias("na"))
    right = rows.groupBy(*scope, F.col(b).alias("c")).agg(F.count(F.lit(1)).alias("nb"))
    chance = left.join(right, [*scope, "c"]).groupBy(*scope).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("meet"))
    agree = shares.groupBy(*scope).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    both = agree.join(chance, scope, "left").withColumn("e", F.coalesce(F.col("meet"), F.lit(0.0)) / (F.col("n") * F.col("n")))
    kappa = F.when(F.col("e") == 1, F.when(F.col("agreement") == 1, 1.0).otherwise(0.0)).otherwise((F.col("agreement") - F.col("e")) / (1 - F.col("e")))
    return both.select(*scope, "n", "agreement", kappa.alias("kappa"))


def class_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; zero denominators give zero."""
    pairs = rows.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("label"), truth, guess)
    t, g = F.col(truth) == F.col("label"), F.col(guess) == F.col("label")
    counts = pairs.groupBy("label").agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("label", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def segregation(profiles: DataFrame, community: str, activity: str, shares: list[str]) -> DataFrame:
    """Activity-weighted divergence of community profiles from the whole."""
    row = sum((F.col(s) for s in shares), F.lit(0.0))
    scaled = profiles.select(community, activity, *[(F.col(s) / row).alias(s) for s in shares])
    mean = lambda by: scaled.groupBy(*by).agg(F.sum(activity).alias("a"), F.array(*[F.sum(F.col(s) * F.col(activity)) / F.sum(activity) for s in shares]).alias("p"))
    whole = mean([]).select(F.col("p").alias("q"))
    return mean([community]).crossJoin(F.broadcast(whole)).agg((F.sum(F.col("a") * jensen_shannon(F.col("p"), F.col("q"))) / F.sum("a")).alias("segregation"), F.count(F.lit(1)).alias("communities"))


def eligibility_flow(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """How many rows are left after each gate in turn."""
    passed, counts = F.lit(True), []
    for i, (name, gate) in enumerate(gates.items()):
        passed = passed & F.coalesce(gate, F.lit(False))
        counts.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("gate"), F.count_if(passed).alias("left")))
    return rows.agg(F.array(*counts).alias("flow")).select(F.explode("flow").alias("f")).select("f.*")


def first_failure(gates: dict[str, Column]) -> Column:
    out = None
    for name, gate in gates.items():
        bad = ~F.coalesce(gate, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out.otherwise("eligible")


def cramer_margins(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cross table with margins, as grouping sets."""
    return rows.cube(a, b).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(a, F.lit("ALL")).alias(a), F.coalesce(b, F.lit("ALL")).alias(b), "n")


__all__ = ["balanced_share", "class_metrics", "cohen_kappa", "concentration", "cramer_margins", "dense_days", "eligibility_flow", "first_failure", "segregation", "support_status", "total", "weighted_prevalence"]
