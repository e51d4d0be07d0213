"""Centroid clustering with Elkan's bounds.

Vectors become integers (floor of SCALE times each component). Every vector keeps an upper bound on its distance to its own centroid
and a lower bound on its distance to each centroid; a round first moves the bounds by how far the centroids moved, then computes a
distance only where neither the lower bound nor half the distance between the centroids rules it out. Bounds are floating-point
numbers rounded outwards at every step, and a centroid is passed over only if it is strictly farther, so ties still meet and go to the
smaller number. Distances that are computed, and all that decide or are returned, are exact integers. A round is one pass over a saved
table, which holds vectors and bounds and replaces the round before; the sums of each cluster are aggregated by Spark.

Defined results: vectors of another length than ``width``, null ones and ones with a null or non-finite component are left out;
repeated rows are clustered each; a null ``vec_id`` enters the starting hash as an empty string; equal hashes are ordered by the
vectors; fewer vectors than ``k`` give as many centroids; an empty table gives an empty table; other columns, whatever their names, are
ignored. Exact 64-bit distances need components below 2**20 in size: larger ones (2**28 after scaling) raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialise
from threadloom.plans.fixpoint import discard

SCALE, WIDTH, K, ROUNDS, SEED = 256, 64, 40, 5, 2
LARGEST = 1 << 28
#: One rounding error is at most 2**-53; each step below makes two or three.
UP, DOWN = 1 + 2.0**-50, 1 - 2.0**-50
#: Vectors that a step holds with their distances.
STEP = 8192
STATE = "vec_id long, codes array<int>, cluster int, distance long, upper double, lower array<float>"


def integer_vectors(table: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``codes``: floor(scale * x) of the vectors with exactly ``width`` finite components."""
    e = F.col("embedding")
    whole = (F.size(e) == width) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(x, lambda v: F.abs(v) < LARGEST)
    codes = F.when(fits, F.transform(x, lambda v: v.cast("int"))).otherwise(F.raise_error(F.lit(f"a component reaches {LARGEST} after scaling")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(whole, F.lit(False))).select("vec_id", codes.alias("codes"))


def starting_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = vectors.withColumn("key", key).orderBy("key", "codes").limit(k).select("codes").collect()  # k rows
    return np.array([r["codes"] for r in chosen], dtype=np.int64)


def root_down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * DOWN


def root_up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * UP


def single_down(x: np.ndarray) -> np.ndarray:
    """As 32-bit numbers, rounded towards zero (bounds are never negative)."""
    out = x.astype(np.float32)
    return np.where(out > x, np.nextafter(out, np.float32(0)), out)


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances; ``centroid`` is one row or a row a point."""
    gap = points - centroid
    return np.einsum("ij,ij->i", gap, gap)


def assign(points: np.ndarray, centroids: np.ndarray, between: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """Settle every point's nearest centroid, changing ``own``, ``upper`` and ``lower``; exact squared distances, and how many were computed.

    ``between`` has lower bounds on half the distances between centroids.
    """
    exact = np.full(len(points), -1, dtype=np.int64)
    computed = 0

    def tighten(rows: np.ndarray) -> None:
        nonlocal computed
        rows = rows[exact[rows] < 0]
        exact[rows] = squared(points[rows], centroids[own[rows]])
        upper[rows], lower[rows, own[rows]] = root_up(exact[rows]), root_down(exact[rows])
        computed += len(rows)

    nearest_other = (between + np.where(np.eye(len(centroids), dtype=bool), np.inf, 0)).min(axis=1)
    active = np.flatnonzero(nearest_other[own] <= upper)
    for j in range(len(centroids)):
        def open_to(rows: np.ndarray, j=j) -> np.ndarray:
            return rows[(own[rows] != j) & (lower[rows, j] <= upper[rows]) & (between[own[rows], j] <= upper[rows])]

        rows = open_to(active)
        tighten(rows)
        rows = open_to(rows)
        if not len(rows):
            continue
        found = squared(points[rows], centroids[j])
        computed += len(rows)
        lower[rows, j] = root_down(found)
        nearer = (found < exact[rows]) | ((found == exact[rows]) & (j < own[rows]))
        rows, found = rows[nearer], found[nearer]
        own[rows], exact[rows], upper[rows] = j, found, root_up(found)
    tighten(np.arange(len(points)))  # the distance is part of the result
    return exact, computed


def moved_bounds(upper: np.ndarray, lower: np.ndarray, own: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that hold after centroids moved by at most ``shift``."""
    return (upper + shift[own]) * UP, np.maximum((lower - shift) * DOWN, 0)


def _round(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """One assignment pass over ``vec_id``, ``codes`` or a table of a round before; centroids and their gaps (k by k) go along."""
    k = len(centroids)
    between = np.array([root_down(squared(centroids, c)) for c in centroids]) / 2
    shift = None if before is None else root_up(squared(centroids, before))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                n = part.num_rows
                points = np.asarray(part["codes"].flatten()).reshape(n, -1).astype(np.int64)
                if shift is None:
                    own, lower = np.zeros(n, dtype=np.int64), np.zeros((n, k))
                    upper = np.full(n, np.inf)
                else:
                    own, lower = np.asarray(part["cluster"]).astype(np.int64), np.asarray(part["lower"].flatten()).reshape(n, k).astype(np.float64)
                    upper, lower = moved_bounds(np.asarray(part["upper"]), lower, own, shift)
                exact, _ = assign(points, centroids, between, own, upper, lower)
                bounds = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(single_down(lower).ravel()))
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["codes"], pa.array(own, pa.int32()), pa.array(exact), pa.array(upper), bounds], names=["vec_id", "codes", "cluster", "distance", "upper", "lower"])

    return state.mapInArrow(emit, STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; an empty one stays where it is."""
    sums = [F.sum(F.col("codes")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # k rows
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return out


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``codes``, ``cluster``, ``distance`` (squared) and the bounds of every vector after ``rounds`` rounds and a last
    assignment, and the centroids."""
    vectors = materialise(integer_vectors(table, width, scale), "vectors")
    centroids, before = starting_centroids(vectors, k, seed), None
    if not len(centroids):
        return table.sparkSession.createDataFrame([], STATE), np.zeros((0, width), dtype=np.int64)
    state = vectors
    for turn in range(rounds + 1):
        last, state = state, materialise(_round(state, centroids, before), "assigned")
        discard(last)
        if turn < rounds:
            before, centroids = centroids, means(state, centroids)
    return state, centroids


def report(table: DataFrame) -> DataFrame:
    state, centroids = cluster(table)
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = table.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    inertia = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows, as the names
    whole = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    few = inertia.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(whole))
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
