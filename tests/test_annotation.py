"""Manual decisions, resampling, series models and Unicode forms against plain implementations."""

from __future__ import annotations

import hashlib
import itertools
import unicodedata
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import unicode
from threadloom.operators import annotation, joins, resampling, series_models


def test_assignment():
    r = np.random.default_rng(1)
    for n, m in [(1, 1), (2, 5), (5, 2), (5, 5), (6, 4), (4, 6)] * 5:
        s = np.round(r.random((n, m)), 1)  # ties are common
        found = annotation.assignment(s)
        short, long = min(n, m), max(n, m)
        best = max(sum(s[i, j] if n <= m else s[j, i] for i, j in enumerate(p)) for p in itertools.permutations(range(long), short))
        assert len({i for i, _ in found}) == len({j for _, j in found}) == short
        assert sum(s[i, j] for i, j in found) == pytest.approx(best)


def test_topic_assignment(spark):
    left = spark.createDataFrame([("x", ["a", "b"]), ("y", ["c"]), ("z", [])], "topic string, terms array<string>")
    right = spark.createDataFrame([("p", ["c", "d"]), ("q", ["a", "b"])], left.schema)
    got = {(r.left, r.right, r.jaccard) for r in annotation.topic_assignment(left, right, "topic", "terms").collect()}
    assert got == {("x", "q", 1.0), ("y", "p", 0.5)}
    assert annotation.topic_assignment(left.limit(0), right, "topic", "terms").count() == 0


def test_cuts_against_all_partitions():
    r = np.random.default_rng(2)

    def cost(v, cuts, penalty):
        edges = [0, *cuts, len(v)]
        return sum(((v[a:b] - v[a:b].mean()) ** 2).sum() for a, b in itertools.pairwise(edges)) + penalty * len(cuts)

    for n in (6, 9, 12):
        v = r.normal(size=n) + (np.arange(n) > n // 2) * 3
        for penalty in (0.5, 2.0):
            ways = [c for k in range(n // 3) for c in itertools.combinations(range(1, n), k) if all(b - a >= 3 for a, b in itertools.pairwise((0, *c, n)))]
            best = min(ways, key=lambda c: cost(v, c, penalty))
            cuts, score = series_models.best_cuts(v, penalty, 3)
            assert tuple(cuts) == best and score == pytest.approx(cost(v, best, penalty))
    assert series_models.best_cuts(np.ones(5), 1.0, 3)[0] == []


def test_change_points(spark):
    rows = [("a", f"2024-01-{k + 1:02d}", 10.0 * (k >= 15) + k % 2) for k in range(30)] + [("flat", f"2024-01-{k + 1:02d}", 1.0) for k in range(30)]
    got = series_models.change_points(spark.createDataFrame(rows, "s string, d string, v double"), "s", "d", "v", 3.0).collect()
    assert [(r.s, str(r.day)) for r in got] == [("a", "2024-01-16")]


def test_f_tail():
    # one and two degrees of freedom above have closed forms
    assert series_models.f_tail(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** -5)
    assert series_models.f_tail(0.0, 3, 7) == pytest.approx(1)
    x = np.random.default_rng(3).chisquare([[4]] * 200_000 + [[12]] * 0, size=(200_000, 1))[:, 0] / 4
    y = np.random.default_rng(4).chisquare(12, size=200_000) / 12
    assert series_models.f_tail(2.5, 4, 12) == pytest.approx(np.mean(x / y > 2.5), abs=0.003)


def test_lag_test(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=120)
    y = np.r_[0, x[:-1]] + 0.1 * r.normal(size=120)
    days = [str(np.datetime64("2024-01-01") + k) for k in range(120)]
    df = spark.createDataFrame([("s", d, float(a), float(b)) for d, a, b in zip(days, y, x, strict=True)], "s string, d string, y double, x double")
    ahead = series_models.lag_test(df, "s", "d", "y", "x", 3, whiten=False).orderBy("lag").collect()
    back = series_models.lag_test(df, "s", "d", "x", "y", 3, whiten=False).orderBy("lag").collect()
    assert [q.lag for q in ahead] == [1, 2, 3] and all(q.p < 1e-20 for q in ahead) and all(q.p > 0.001 for q in back)
    assert series_models.lag_test(df.limit(4), "s", "d", "y", "x", 3).count() == 0
    assert series_models.lag_test(df, "s", "d", "y", "x", 3).first().p < 1e-6


def test_elastic_net_meets_its_conditions():
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 2))
    y = 2 * x[:, 0] + 0.05 * x[:, 1] + 5 + 0.1 * r.normal(size=60)
    w, c = series_models.elastic_net(x, y, 0.1, 0.5)
    slope = (x - x.mean(0)).T @ (y - c - x @ w) / 60 - 0.05 * w
    for g, v in zip(slope, w, strict=True):
        assert g == pytest.approx(0.05 * np.sign(v), abs=1e-6) if v else abs(g) <= 0.05 + 1e-6
    plain, b = series_models.elastic_net(x, y, 0.0, 0.5)
    assert [b, *plain] == pytest.approx(np.linalg.lstsq(np.c_[np.ones(60), x], y, rcond=None)[0].tolist(), abs=1e-6)


def test_lag_forecasts(spark):
    v = [0.0] * 7
    for k in range(7, 60):
        v.append(1 + 0.5 * v[k - 1] - 0.2 * v[k - 7] + (k % 5))
    v = [float(k) for k in v]
    df = spark.createDataFrame([("s", str(np.datetime64("2024-01-01") + k), x) for k, x in enumerate(v)], "s string, d string, v double")
    got = series_models.lag_forecasts(df, "s", "d", "v", 28).orderBy("day").collect()
    assert len(got) == 32 and all(r.seasonal == v[28 + k - 7] for k, r in enumerate(got))
    x = np.array([[1, v[k - 1], v[k - 7]] for k in range(7, 40)])
    b = np.linalg.lstsq(x, np.array(v[7:40]), rcond=None)[0]
    assert got[12].autoregressive == pytest.approx(float(np.array([1, v[39], v[33]]) @ b))


def test_thread_bootstrap(spark):
    rows = [("n", f"t{k % 4}", f"a{k % 6}", k % 3 == 0) for k in range(60)] + [("o", f"t{k % 3}", f"a{k % 5}", k % 7 == 0) for k in range(45)] + [("n", "t9", "", True), ("n", "t9", None, True), ("x", "t0", "a", True)]
    df = spark.createDataFrame(rows, "c string, t string, a string, y boolean")
    got = resampling.thread_bootstrap_difference(df, "c", "n", "o", "t", "a", F.col("y"), 300).first()

    def share(case):
        own = {}
        for c, _, a, y in rows:
            if c == case and a:
                own.setdefault(a, []).append(y)
        return np.mean([np.mean(v) for v in own.values()])

    key = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:15], 16)
    seen, boot = share("n") - share("o"), []
    for r in range(1, 301):
        side = {}
        for case in "no":
            threads = sorted({t for c, t, a, _ in rows if c == case and a})
            own = {}
            for slot in range(len(threads)):
                t = threads[key("h", case, r, slot) % len(threads)]
                for c, q, a, y in rows:
                    if c == case and q == t and a:
                        own.setdefault((a, slot), []).append(y)  # an author of a thread drawn twice is two
            side[case] = np.mean([np.mean(v) for v in own.values()])
        boot.append(side["n"] - side["o"])
    want = [seen, *np.quantile(boot, [0.025, 0.5, 0.975]), (1 + np.sum(np.array(boot) >= 2 * seen)) / 301]
    assert [got.observed, got.low, got.median, got.high, got.p] == pytest.approx(want)
    flat = resampling.thread_bootstrap_difference(df, "c", "n", "o", "t", "a", F.col("y"), 20, balanced=False).first()
    assert flat.observed == pytest.approx(np.mean([y for c, _, _, y in rows if c == "n"]) - np.mean([y for c, _, _, y in rows if c == "o"]))


def test_power(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(50)] + [("b", 1.0)], "g string, y double")
    got = resampling.power_diagnostic(df, "g", F.col("y"), 5.0, two_sided=True).collect()
    n, sd = 50, np.std(range(50), ddof=1)
    z, q = NormalDist(), NormalDist().inv_cdf(0.975)
    e = sd / np.sqrt(n)
    assert len(got) == 1 and got[0].mde == pytest.approx((q + z.inv_cdf(0.8)) * e)
    assert got[0].power == pytest.approx(1 - z.cdf(q - 5 / e) + z.cdf(-q - 5 / e))


def test_overrides(spark):
    rows = spark.createDataFrame([("c", "t1_a"), ("c", "b"), ("c", "t1_z"), ("p", "t1_a"), ("c", "t1_a"), (None, None)], "thing string, key string")
    over = spark.createDataFrame([("c", "a", "Exclude"), ("c", "t1_b", " english "), ("c", "t1_a", "non_english"), ("c", "", "bad"), ("c", "q", None)], "thing string, key string, value string")
    got = sorted((r.thing or "", r.key or "", r.override) for r in annotation.apply_overrides(rows, over, "thing", "key", F.lit("t1_")).collect())
    assert got == sorted([("c", "t1_a", "non_english"), ("c", "t1_a", "non_english"), ("c", "b", "english"), ("c", "t1_z", None), ("p", "t1_a", None), ("", "", None)], key=lambda x: x[:2])
    with pytest.raises(Exception, match="unknown override"):
        annotation.apply_overrides(rows, over.union(spark.createDataFrame([("c", "a", "maybe")], over.schema)), "thing", "key", F.lit("t1_")).collect()


def test_unicode(spark):
    texts = ["", "  A  b\tC ", "ｆｕｌｌ  Ｗｉｄｔｈ", "𝓢𝓽𝔂𝓵𝓮𝓭 x", "état É", "ﬁn", None, "Ngày", "﻿Vương quốc Anh", "x" * 100_000]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(texts)], "k int, s string")
    s = F.col("s")
    got = df.select("k", unicode.normal_form(s, "NFC").alias("c"), unicode.folded_text(s).alias("f"), unicode.text_hash(s).alias("h"), unicode.folded_header(s).alias("d")).orderBy("k").collect()
    for r, x in zip(got, texts, strict=True):
        want = None if x is None else " ".join(unicodedata.normalize("NFKC", x).lower().split())
        assert r.f == want and r.c == (None if x is None else unicodedata.normalize("NFC", x))
        assert r.h == (None if x is None else hashlib.md5(want.encode()).hexdigest() if want else "")
    assert (got[7].d, got[8].d, got[6].d, got[4].d) == ("ngay", "vuong quoc anh", "", "etat e")
    cells = spark.createDataFrame([(k, c) for k, c in enumerate(["<1", " 1,234% ", "", "n/a", None, "7.5"])], "k int, c string")
    assert [r.v for r in cells.select("k", unicode.trend_value(F.col("c")).alias("v")).orderBy("k").collect()] == [0.5, 1234.0, None, None, None, 7.5]
    heads = spark.createDataFrame([(k, c) for k, c in enumerate(["new zealand", "trend: uk", "uc (x)", "ieee", "au", "x ie"])], "k int, c string")
    assert [r.v for r in heads.select("k", unicode.country(F.col("c")).alias("v")).orderBy("k").collect()] == ["NZ", "UK", "AU", None, "AU", "IE"]


def test_many_windows_meet_by_day(spark):
    at = [f"2024-01-{1 + k % 9:02d} {k % 24:02d}:00:00" for k in range(60)] + [None]
    rows = spark.createDataFrame(list(enumerate(at)), "id int, s string").select("id", F.col("s").cast("timestamp").alias("at"))
    spans = [(k, f"2024-01-{1 + k % 7:02d} 0{k % 10}:30:00", f"2024-01-{1 + k % 7 + k % 3:02d} 0{k % 10}:{'30' if k % 5 else '10'}:00") for k in range(12)]
    dim = spark.createDataFrame(spans, "w int, s string, e string").select("w", F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))
    want = sorted((k, w) for k, x in enumerate(at) if x for w, s, e in spans if s <= x < e)
    for bound in (100, 3):
        got = joins.in_window(rows, F.col("at"), dim, bound=bound)
        assert sorted((r.id, r.w) for r in got.collect()) == want and got.columns == ["id", "at", "w", "start", "end"]
