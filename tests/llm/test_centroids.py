"""Centroid clustering against plain rounds with all distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>"


def rows(seed=3, n=400):
    r = random.Random(seed)
    grid = [-0.5, -0.25, 0.0, 0.25, 0.5]  # few values, so equal vectors and equal distances abound
    out = [(i, [r.choice(grid) if k < 3 else 0.0 for k in range(64)]) for i in range(n)] + [(n + i, [r.uniform(-1, 1) for _ in range(64)]) for i in range(n)]
    out += [(5000, None), (5001, []), (5002, [0.1] * 63), (5003, [0.1] * 65), (5004, [None] + [0.1] * 63), (5005, [math.nan] + [0.1] * 63), (5006, [math.inf] + [0.1] * 63)]
    return out + [(None, [0.3] * 64), (7, out[7][1]), (7, out[8][1])] + [(6000 + i, [0.25] * 64) for i in range(300)]


def plain(table, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in table if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    middle = [v for _, v in first]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(middle)) for _, v in kept]
        if turn < rounds:
            for j in range(len(middle)):
                own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
                if own:
                    middle[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = [sum(d for d, c in near if c == j) for j in range(len(middle))]
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((i, c, d, total[c], sum(total), name[c]) for (i, _), (d, c) in zip(kept, near, strict=True)), key=str)


def test_equals_plain_rounds(spark):
    clash = [F.lit(1).alias(c) for c in ("codes", "cluster", "distance", "upper", "lower", "key", "label")]
    table = spark.createDataFrame(rows(), SCHEMA).select("*", *clash).repartition(5)
    got = [tuple(r) for r in centroids.report(table).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    assert sorted(got, key=str) == plain(rows())


def test_fewer_vectors_than_centroids_and_none(spark):
    few = [(i, [i / 10] * 64) for i in range(7)] + [(7, [0.3] * 64)]
    got = centroids.report(spark.createDataFrame(few, SCHEMA)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain(few)
    for none in ([], [(1, None)]):
        assert centroids.report(spark.createDataFrame(none, SCHEMA)).count() == 0


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="after scaling"):
        centroids.report(spark.createDataFrame([(1, [2.0**20] + [0.0] * 63)], SCHEMA)).count()


def test_bounds_hold_and_spare_distances():
    g = np.random.default_rng(1)
    middle = g.integers(-200, 200, (12, 8))
    points = np.concatenate([middle[g.integers(0, 12, 3000)] + g.integers(-20, 20, (3000, 8)), (middle[:6] + middle[6:]) // 2])
    own, upper, lower, before, spent = np.zeros(len(points), np.int64), np.full(len(points), np.inf), np.zeros((len(points), 12)), None, []
    for _ in range(6):
        if before is not None:
            upper, lower = centroids.moved_bounds(upper, lower, own, centroids.root_up(centroids.squared(middle, before)))
            true = np.sqrt(((points[:, None] - middle[None]) ** 2).sum(axis=2))
            assert (upper >= true[np.arange(len(points)), own]).all() and (lower <= true).all()
        between = np.array([centroids.root_down(centroids.squared(middle, c)) for c in middle]) / 2
        exact, computed = centroids.assign(points, middle, between, own, upper, lower)
        lower = centroids.single_down(lower).astype(float)
        true = ((points[:, None] - middle[None]) ** 2).sum(axis=2)
        assert (own == true.argmin(axis=1)).all() and (exact == true.min(axis=1)).all()
        spent.append(computed)
        before, middle = middle, np.array([np.floor_divide(points[own == j].sum(axis=0), max((own == j).sum(), 1)) if (own == j).any() else middle[j] for j in range(12)])
    assert max(spent[1:]) < 0.35 * len(points) * 12


def test_single_precision_rounds_down():
    x = np.r_[0.0, np.random.default_rng(2).uniform(0, 1e9, 1000)]
    assert (centroids.single_down(x).astype(float) <= x).all()
