"""Queries against brute force over whole tables of the smallest scale."""

from collections import defaultdict

import duckdb
import pytest

from threadloom import registry
from threadloom.operators.graph import pagerank

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def graph():
    """Neighbours of every customer and (negative) supplier over all lineitems."""
    near = defaultdict(set)
    for a, b in duckdb.sql(f"SELECT o_custkey, -(l_suppkey + 1) FROM '{SF}/orders.parquet' JOIN '{SF}/lineitem.parquet' ON o_orderkey = l_orderkey ").fetchall():
        near[a].add(b)
        near[b].add(a)
    return near


def test_components_of_the_whole_graph(spark, graph):
    left, want = set(graph), []
    while left:
        own, todo = set(), [min(left)]
        while todo:
            own.add(n := todo.pop())
            todo += graph[n] - own
        want.append((min(own), len(own)))
        left -= own
    assert rows(registry.queries()["component_sizes"](spark, SF)) == sorted(want)


def test_cores_of_the_whole_graph(spark, graph):
    near, want, k = {n: set(o) for n, o in graph.items()}, {}, 0
    while near:
        n = min(near, key=lambda x: len(near[x]))
        k = want[n] = max(k, len(near[n]))
        for o in near.pop(n):
            near[o].remove(n)
    assert rows(registry.queries()["core_numbers"](spark, SF)) == sorted(want.items())


def lines():
    return duckdb.sql(f"SELECT o_custkey, l_suppkey, count(*) FROM '{SF}/orders.parquet' JOIN '{SF}/lineitem.parquet' ON o_orderkey = l_orderkey GROUP BY ALL").fetchall()


def test_pagerank_has_converged(spark):
    edges = [(a, -(b + 1), w) for a, b, w in lines()]
    nodes, out = {n for a, b, _ in edges for n in (a, b)}, defaultdict(int)
    for a, _, w in edges:
        out[a] += w
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(400):
        new = dict.fromkeys(nodes, (0.15 + 0.85 * sum(r for n, r in rank.items() if n not in out)) / len(nodes))
        for a, b, w in edges:
            new[b] += 0.85 * rank[a] * w / out[a]
        rank = new
    got = dict(rows(registry.queries()["actor_pagerank"](spark, SF)))
    assert got.keys() == rank.keys() and sum(abs(got[n] - r) for n, r in rank.items()) < 1e-6 * 0.85 / 0.15 + 1e-9 * len(rank)


def test_pagerank_fails_at_its_bound(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 1, 1)], "s long, t long, w long")
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        pagerank(e, "s", "t", "w", rounds=3, tolerance=1e-6)
    assert pagerank(e.limit(0), "s", "t", "w").count() == 0


def test_birank_of_a_hundred_rounds(spark):
    edges = lines()
    x, y = {a: 1.0 for a, _, _ in edges}, {b: 1.0 for _, b, _ in edges}
    for _ in range(100):
        nx, ny = dict.fromkeys(x, 0.0), dict.fromkeys(y, 0.0)
        for a, b, w in edges:
            nx[a] += w * y[b]
            ny[b] += w * x[a]
        x, y = {n: v / sum(nx.values()) for n, v in nx.items()}, {n: v / sum(ny.values()) for n, v in ny.items()}
    got = {(r.side, r.node): r.score for r in registry.queries()["bipartite_birank"](spark, SF).collect()}
    assert got == pytest.approx({("left", n): v for n, v in x.items()} | {("right", n): v for n, v in y.items()}, abs=2e-9)
