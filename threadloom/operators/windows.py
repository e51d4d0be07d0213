"""Window operators: ranks, bins, top-k, sustained windows, upserts, quotas and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quartile_bins(rows: DataFrame, group: list[str], order: list[str], bins: int = 4) -> DataFrame:
    """Ordinal rank (ties by order) cut into equal bins."""
    w = Window.partitionBy(*group)
    return rows.withColumn("bin", F.floor((F.row_number().over(w.orderBy(*order)) - 1) * bins / F.count(F.lit(1)).over(w)).cast("int"))


def average_rank(value: str, group: list[str]) -> Column:
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2


def spearman(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    ranked = rows.select(*group, average_rank(a, group).alias("ra"), average_rank(b, group).alias("rb"))
    return ranked.groupBy(*group).agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def top_k(rows: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order, as in an upsert where a later source wins."""
    return top_k(rows, key, order, 1).drop("place")


def sustained(rows: DataFrame, group: list[str], day: str, width: int = 7, least: int = 3, windows: int = 2) -> DataFrame:
    """Earliest observed day from which each of the next ``windows`` windows of ``width`` days holds ``least`` rows."""
    daily = rows.groupBy(*group, day).agg(F.count(F.lit(1)).alias("n")).withColumn("_d", F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(*group).orderBy("_d")
    for i in range(windows):
        daily = daily.withColumn(f"_w{i}", F.coalesce(F.sum("n").over(w.rangeBetween(i * width, (i + 1) * width - 1)), F.lit(0)))
    held = F.lit(True)
    for i in range(windows):
        held = held & (F.col(f"_w{i}") >= least)
    return daily.where(held).groupBy(*group).agg(F.min(day).alias("uptake"))


def capped(rows: DataFrame, group: list[str], key: Column, tie: str, cap: int, p: str) -> DataFrame:
    """At most ``cap`` rows a group in hash order, with the probability of being kept."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy(key, tie))).withColumn(p, F.least(F.lit(cap), F.count(F.lit(1)).over(w)) / F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_rn") <= cap).drop("_rn")


def largest_remainder(cells: DataFrame, size: str, seats: int, cell: str) -> DataFrame:
    """Proportional allocation of ``seats`` over cells, remainders to the largest fractions, ties by cell; cells are few."""
    w = Window.partitionBy()
    exact = cells.withColumn("_x", F.col(size) * F.lit(seats) / F.sum(size).over(w)).withColumn("_f", F.floor("_x"))
    rest = exact.withColumn("_left", F.lit(seats) - F.sum("_f").over(w)).withColumn("_rn", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), cell)))
    return rest.withColumn("quota", (F.col("_f") + F.when(F.col("_rn") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_x", "_f", "_left", "_rn")
