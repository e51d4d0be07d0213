"""Numeric scalars and small statistics over arrays and columns."""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def entropy_normalised(p: Column, k: int) -> Column:
    """Natural-log entropy of a distribution over ``k`` classes, divided by ``ln k``."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0))) / F.ln(F.lit(float(k)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence in bits of two arrays of shares; zero terms add nothing."""
    half = lambda a, b: total(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)))
    return (half(p, q) + half(q, p)) / 2


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = hits / n
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (centre - spread) / scale, (centre + spread) / scale


def holm(tests: DataFrame, p: str = "p", name: str = "name") -> DataFrame:
    """Step-down adjusted p-values; a family of tests is small by nature, so one window holds it."""
    order = Window.orderBy(p, name)
    step = tests.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    running = Window.orderBy(p, name).rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("adjusted", F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))).over(running)).drop("_i", "_m")


def stable_key(*parts: Column) -> Column:
    """A 60-bit number from md5, the same in any SQL engine: orders, splits and draws hang on it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def stable_keys(head: str, names: list[bytes]) -> np.ndarray:
    """``stable_key`` of many rows in a task: of ``head`` and each name, the parts' bar in ``head``."""
    start = head.encode()
    return (np.frombuffer(b"".join([md5(start + x).digest() for x in names]), ">u8")[::2] >> 4).astype(np.int64)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
