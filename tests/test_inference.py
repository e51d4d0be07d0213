"""Operators without SQL, or whose failure is the feature, against plain implementations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import prepare
from threadloom.operators import inference, networks, populations, timeseries


#: Texts and what a reader of the rule expects of them.
MASKED = {
    "see HTTPS://a.b/c?d and www.x.y<z": "see <URL> and <URL><z",
    "https://ä.example/ü\u00a0next": "<URL>\u00a0next",
    "mail a.b+c@d-e.co.uk now": "mail <PII> now",
    "josé@x.com": "<PII>",
    "müller.hans@firma.de, bitte": "<PII>, bitte",
    "имя@почта.рф": "<PII>",
    "x@y": "x@y",  # a domain has a dot, and a handle no letter before it
    "éa@b": "éa@b",
    "a@b.c.": "a@b.c.",  # a dot behind the domain: no address; the handle has a letter before it
    "by @some_one.x and (@b)": "by @user and (@user)",
    "@éric @_x @@y": "@éric @user @@y",
    "call +44 (0) 20 7946 0958 today": "call <PII> today",
    "call ٠٢٠ ٧٩٤٦ ٠٩٥٨ today": "call <PII> today",
    "020\u00a07946\u00a00958": "<PII>",
    "on 2024-01-05, at 12:30": "on 2024-01-05, at 12:30",
    "on 2024-01-05 12:30": "on <PII>:30",  # ten digits in a row of digits, blanks and hyphens
    "1234-5678": "1234-5678",
    "1234-5678 90": "<PII>",
    "12.03.2024 - x 0123456789": "12.03.2024 - x <PII>",
    "é0123456789": "é0123456789",
    "no marks": "no marks",
    "12 34 56 78 9": "<PII>",
    "": "",
}


def test_shared_mask(spark):
    rows = [*enumerate(MASKED.items()), (len(MASKED), (None, ""))]
    table = spark.createDataFrame([(i, x, want) for i, (x, want) in rows], "i long, x string, want string")
    assert [(r.x, r.got) for r in table.select("x", "want", prepare.shared_mask(F.col("x")).alias("got")).collect() if r.got != r.want] == []


def test_shared_mask_of_a_long_address(spark):
    table = spark.createDataFrame([("a@" + "b." * 20_000 + "c " + "d" * 50_000,)], "x string")
    assert table.select(prepare.shared_mask(F.col("x"))).first()[0] == "<PII> " + "d" * 50_000


@pytest.fixture(scope="module")
def graph():
    r = random.Random(6)
    return sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(55)} | {(40, 41), (41, 42)})


@pytest.fixture(scope="module")
def edges(spark, graph):
    return spark.createDataFrame([(a, b, 1.0) for a, b in graph], "a long, b long, w double")


def neighbours(graph):
    near = {}
    for a, b in graph:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def test_betweenness(graph, edges):
    near = neighbours(graph)

    def paths(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [[*p, v] for p in level for v in near[p[-1]] if v not in p]
        return found

    def shortest(s):
        depth, order = {s: 0}, [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
        return depth

    want, n = dict.fromkeys(near, 0.0), len(near)
    far = {s: shortest(s) for s in near}
    ways = {}
    for s in near:
        ways[s] = {s: 1}
        for v in sorted(far[s], key=far[s].get)[1:]:
            ways[s][v] = sum(ways[s][w] for w in near[v] if far[s][w] == far[s][v] - 1)
    for s in near:
        for t in far[s]:
            if s < t:
                for v in far[s]:
                    if v not in (s, t) and far[s][v] + far[v][t] == far[s][t]:
                        want[v] += ways[s][v] * ways[v][t] / ways[s][t]
    got = {r.node: r.betweenness for r in networks.betweenness(edges, "a", "b").collect()}
    assert got == pytest.approx({v: x * 2 / ((n - 1) * (n - 2)) for v, x in want.items()})


def test_betweenness_refuses_what_it_cannot_hold(edges, monkeypatch):
    monkeypatch.setattr(networks, "HELD_EDGES", 10)
    with pytest.raises(ValueError, match="at most 10"):
        networks.betweenness(edges, "a", "b")


def test_personalised_pagerank(spark, graph, edges):
    nodes = sorted({v for e in graph for v in e})
    out = {}
    for a, b in graph:
        out.setdefault(a, []).append(b)
    home = {v: {1: 0.25, 2: 0.75}.get(v, 0.0) for v in nodes}
    rank = dict(home)
    for _ in range(300):
        idle = sum(x for v, x in rank.items() if v not in out)
        new = {v: home[v] * (0.15 + 0.85 * idle) for v in nodes}
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * rank[a] / len(bs)
        rank = new
    seeds = spark.createDataFrame([(1, 1.0), (2, 3.0), (999, 5.0)], "node long, mass double")
    got = {r.node: r["rank"] for r in networks.personalised_pagerank(edges, "a", "b", "w", seeds, tolerance=1e-10).collect()}
    assert got == pytest.approx(rank, abs=1e-6)
    nobody = networks.personalised_pagerank(edges, "a", "b", "w", seeds.where("node = 999"))
    assert {r["rank"] for r in nobody.collect()} == {None}


def test_vote_rank(graph, edges):
    near = neighbours(graph)
    power, weak, want = dict.fromkeys(near, 1.0), len(near) / sum(map(len, near.values())), []
    for _ in range(6):
        votes = {v: sum(power[w] for w in near[v]) for v in near if v not in want}
        best = min(votes, key=lambda v: (-round(votes[v], 9), v))
        want.append(best)
        power[best] = 0.0
        for w in near[best]:
            power[w] = max(0.0, power[w] - weak)
    assert [r.node for r in networks.vote_rank(edges, "a", "b", 6).orderBy("place").collect()] == want


def test_caliper_matching(spark):
    r = random.Random(2)
    rows = [(i, i % 2, i % 7 == 0, r.randint(1, 30), r.randint(1, 30)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, c long, broker boolean, x long, y long")
    got = inference.mahalanobis_caliper(df, "id", "c", F.col("broker"), ~F.col("broker"), "x", "y").collect()
    assert got and len({r.matched for r in got}) == len(got)
    z = {}
    for c in (0, 1):
        own = [q for q in rows if q[1] == c]
        x, y = (np.log1p([q[k] for q in own]) for k in (3, 4))
        z |= {q[0]: (a, b) for q, a, b in zip(own, (x - x.mean()) / x.std(), (y - y.mean()) / y.std(), strict=True)}
    kind = {q[0]: q for q in rows}
    for m in got:
        assert kind[m.treated][2] and not kind[m.matched][2] and kind[m.treated][1] == kind[m.matched][1] == m.c
        assert all(abs(p - q) <= 0.2 + 1e-9 for p, q in zip(z[m.treated], z[m.matched], strict=True))


def test_segmented_trend(spark):
    days = [np.datetime64("2024-01-01") + k for k in range(56)]
    value = [5 + 0.5 * k + (k >= 28) * (7 + 0.25 * (k - 28)) + (k % 7 == 2) * 3 for k in range(56)]
    df = spark.createDataFrame([("s", str(d), v) for d, v in zip(days, value, strict=True)], "name string, day string, v double")
    got = {r.term: r.estimate for r in timeseries.segmented_trend(df, "name", "day", "v", "2024-01-29").collect()}
    assert (got["trend"], got["level"], got["slope"]) == pytest.approx((0.5, 7, 0.25))


def test_errors_are_raised(spark):
    rows = spark.createDataFrame([(1, "2024-01-02")], "id long, d string").withColumn("at", F.col("d").cast("timestamp"))
    lap = spark.createDataFrame([("a", "2024-01-01", "2024-01-05"), ("b", "2024-01-02", "2024-01-03")], "scope string, s string, e string").select("scope", F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))
    assert populations.first_window(rows, F.col("at"), lap, "id").first().scope == "a"
    with pytest.raises(Exception, match="overlap"):
        populations.case_window(rows, F.col("at"), lap).collect()
    with pytest.raises(ValueError, match="needs host"):
        populations.robustness_filter(rows, "x", {"x": (["host"], F.lit(True))})


def test_permutations_in_tasks_and_beyond_what_a_task_holds(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id AS k", "id % 7 AS s", "id % 3 = 0 AS l", "CAST((id * 37) % 101 AS double) AS y")
    call = lambda: tuple(inference.stratified_permutation(rows, "k", ["s"], "l", "y", 20).first())
    plan = inference.stratified_permutation(rows, "k", ["s"], "l", "y", 20)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" in plan and "Generate explode(sequence(1, 20" not in plan
    held = call()
    monkeypatch.setattr(inference, "HELD_ROWS", 42)
    assert call() == pytest.approx(held)
    units = spark.range(200).selectExpr("id % 9 AS m", "id AS u", "id < 9 AS t", "CAST((id * 37) % 101 AS double) AS y")
    plan = inference.matched_set_permutation(units, "m", "u", "t", "y", 20)._jdf.queryExecution().toString()
    assert "row_number" not in plan and "min_by" in plan
