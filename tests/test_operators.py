"""Operators on tiny frames with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import stats, text
from threadloom.operators import aggregates, graph, joins, windows


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_author_balanced_differs_from_document_weighted(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "a", 1), ("s", "a", 1), ("s", "b", 0)], "scope string, author string, hit int")
    got = aggregates.balanced_share(df, ["scope"], "author", F.col("hit")).first()
    assert (got.document_share, got.author_share, got.authors) == (0.75, 0.5, 2)


def test_weighted_prevalence_and_kish(spark):
    df = spark.createDataFrame([("p", 1, 0.5), ("p", 0, 1.0)], "g string, y int, p double")
    got = aggregates.weighted_prevalence(df, ["g"], F.col("y"), F.col("p")).first()
    assert got.prevalence == pytest.approx(2 / 3) and got.effective_n == pytest.approx(9 / 5)


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert [r.adjusted for r in stats.holm(df).orderBy("p").collect()] == pytest.approx([0.03, 0.06, 0.06])


def test_nearest_prefers_the_earlier_on_a_tie(spark):
    cal = spark.createDataFrame([("x", "2024-01-01"), ("y", "2024-01-03")], "name string, w string").withColumn("w", F.to_date("w"))
    df = spark.createDataFrame([(1, "2024-01-02")], "id int, d string").withColumn("d", F.to_date("d"))
    assert rows(joins.nearest(df, "id", F.col("d"), cal, "w", "name").select("nearest", "offset_days")) == [("x", 1)]


def test_guarded_join_fails_on_a_repeated_key(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeats"):
        joins.many_to_one(left, right, "k").collect()


def test_sustained_uptake(spark):
    days = [("c", d) for d in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-08", "2024-01-09", "2024-01-10")]
    df = spark.createDataFrame(days, "c string, d string").withColumn("d", F.to_date("d"))
    assert str(windows.sustained(df, ["c"], "d").first().uptake) == "2024-01-01"


def test_components_cores_and_reach(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)], "a long, b long")
    assert rows(graph.component_sizes(e)) == [(1, 4), (8, 2)]
    assert rows(graph.core_numbers(e, "a", "b")) == [(1, 2), (2, 2), (3, 2), (4, 1), (8, 1), (9, 1)]
    tree = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "p long, c long")
    assert rows(graph.reach_levels(tree, "p", "c").select("node", "depth")) == [(1, 0), (2, 1), (3, 2), (4, 1)]


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 2)], "s long, t long, w long")
    assert graph.pagerank(e, "s", "t", "w", rounds=5).agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_text_scalars(spark):
    df = spark.createDataFrame([("mail a.b@c.org or @someone at https://x.y now",)], "t string")
    assert df.select(text.masked(F.col("t"))).first()[0] == "mail <EMAIL> or <USER> at <URL> now"
    q = spark.createDataFrame([("> quoted\nown",)], "t string")
    assert q.select(text.without_quotes(F.col("t"))).first()[0] == "own"
    e = spark.createDataFrame([("", None)], "a string, b string")
    assert e.select(text.presence(F.col("a"), F.col("b"))).first()[0] == "empty"


def test_kappa_without_variation(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 1, 1)], "g string, a int, b int")
    assert aggregates.cohen_kappa(df, ["g"], "a", "b").first().kappa == 1.0
