"""Queries on communities, null models, topics and keyed streams; what has no SQL is held against plain implementations in ``tests/``."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import stats
from threadloom.operators import communities, contrasts, rewiring, topics
from threadloom.registry import _drained, _event_stream, nation_edges, query, r9, t
from threadloom.registry_inference import key_sql, trade
from threadloom.streaming import threads

# Communities


def traders(spark, d):
    """Which nation each customer and supplier of ``trade`` is of."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    return c.unionByName(t(spark, d, "supplier").select((-(F.col("s_suppkey") + 1)).alias("node"), F.col("s_nationkey").alias("community")))


@query()
def community_grid(spark, d):
    """The stability table of the whole grid, six resolutions of twenty seeds, on trade between nations."""
    links = communities.undirected(nation_edges(spark, d), "s", "t", "w").cache()
    runs = communities.grid(links)
    member = communities.saved(communities.partitions(links, runs), "member")
    table = communities.stability(communities.described(links, runs, member), communities.agreement(member, runs))
    return table.select("resolution", "seed_count", *[r9(c).alias(c) for c in ("median_pairwise_ari", "median_pairwise_nmi", "mean_modularity", "best_modularity")], "eligible", "selected", "best_seed", "status")


@query()
def trade_communities(spark, d):
    """Communities of the graph of all customers and suppliers."""
    links = communities.undirected(trade(spark, d), "a", "b", "w")
    return communities.over_periods(links).select("node", "community")


@query()
def yearly_communities(spark, d):
    """Communities of each year's trade between nations, and what became of them."""
    x = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    edges = x.groupBy(F.year("o_orderdate").alias("year"), F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("t")).agg(F.count(F.lit(1)).alias("w"))
    links = communities.saved(communities.undirected(edges, "s", "t", "w", "year"), "links")
    rows = communities.period_summary(links, communities.saved(communities.over_periods(links), "member"))
    return rows.withColumns({c: r9(c) for c in ("modularity", "mean_best_overlap")})


@query()
def null_modularity(spark, d):
    """Whether trade keeps within nations more than in graphs of the same degrees."""
    return rewiring.null_modularity(trade(spark, d), "a", "b", "w", traders(spark, d))


# Topics


@query()
def topic_models(spark, d):
    """Every model of the grid with its measures; the chosen one is marked."""
    chosen = topics.topic_models(t(spark, d, "documents"), "doc_id", "text")[1]
    return spark.createDataFrame(chosen.table, topics.MODEL_COLUMNS)


@query()
def topic_shares(spark, d):
    """How many documents of each language fall to each topic of the chosen model, the share with its interval, and the topic's terms."""
    docs = t(spark, d, "documents")
    state, chosen, models = topics.topic_models(docs, "doc_id", "text")
    terms = spark.createDataFrame([(i, ", ".join(x)) for i, x in enumerate(chosen.terms)], "topic int, terms string")
    own = topics.assigned(state, "doc_id", models).where(F.col("model") == chosen.model).join(docs.select("doc_id", "lang"), "doc_id")
    counted = topics.saved(own.groupBy("lang", "topic").agg(F.count(F.lit(1)).alias("documents")), "counts")
    grid = counted.select("lang").distinct().crossJoin(F.broadcast(terms))  # a row a language and topic
    whole = grid.join(counted, ["lang", "topic"], "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    whole = whole.join(counted.groupBy("lang").agg(F.sum("documents").alias("n")), "lang")
    low, high = stats.wilson(F.col("documents"), F.col("n"), 1.96)
    return whole.select("lang", "topic", "documents", r9(F.col("documents") / F.col("n")).alias("share"), r9(F.greatest(low, F.lit(0.0))).alias("low"), r9(F.least(high, F.lit(1.0))).alias("high"), "terms")


# Keyed streams

_VIEWED = "SELECT event_id AS id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target, ts, event_type FROM events"


@query(f"SELECT id, target FROM ({_VIEWED}) WHERE event_type = 'purchase'")
def last_view_before(spark, d):
    """The user's last view before each purchase."""
    return threads.last_of_handle(t(spark, d, "events"), "user_id", "event_type", F.when(F.col("event_type") == "purchase", "view"), "ts", "event_id")


@query(f"SELECT id, target FROM ({_VIEWED}) WHERE event_type = 'purchase' AND date_trunc('millisecond', ts) < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)")
def stream_last_view_before(spark, d):
    """The same over a stream, for the purchases that the watermark, a day behind the last event, has passed. Only views can be named, so
    other events are kept as posts of nobody: the stream has one group of state a user."""
    rows = _event_stream(spark, d).withColumn("handle", F.when(F.col("event_type") == "view", "view"))
    return _drained(spark, threads.last_of_handle_stream(rows, "user_id", "handle", F.when(F.col("event_type") == "purchase", "view"), "ts", "event_id", "1 day"), "append")


# Contrasts

_UNITS = """b AS (SELECT l_suppkey AS c, l_returnflag AS e, l_suppkey % 2 = 0 AS f, [l_quantity, 1 + 100 * l_discount, 1 + 100 * l_tax] AS p, [day(l_shipdate), month(l_shipdate), l_linenumber]::DOUBLE[] AS q FROM lineitem),
a AS (SELECT c, e, f, 1 - list_sum(list_transform(list_zip(list_transform(p, lambda x: x / list_sum(p)), list_transform(q, lambda x: x / list_sum(q))), lambda z: z[1] * log2(2 * z[1] / (z[1] + z[2])) + z[2] * log2(2 * z[2] / (z[1] + z[2])))) / 2 AS y FROM b),
cell AS (SELECT c, f, e, count(*)::DOUBLE AS n, sum(y) AS y FROM a GROUP BY ALL)"""
_CONTRAST = "SELECT r, sum(y1 - n1 * y / n) / sum(n1 - n1 * n1 / n) AS d FROM (SELECT r, e, sum(n) AS n, sum(y) AS y, sum(CASE WHEN f THEN n ELSE 0 END) AS n1, sum(CASE WHEN f THEN y ELSE 0 END) AS y1 FROM {} GROUP BY ALL) GROUP BY r"


@query(f"""WITH {_UNITS}, o AS ({_CONTRAST.format('(SELECT 0 AS r, * FROM cell)')}),
k AS (SELECT *, count(*) FILTER (WHERE f) OVER (PARTITION BY sg) AS many, row_number() OVER (PARTITION BY f ORDER BY c) - 1 AS place, count(*) OVER (PARTITION BY f) AS m FROM (SELECT c, f, list(e ORDER BY e) AS sg FROM cell GROUP BY c, f)),
p AS (SELECT r, c, row_number() OVER (PARTITION BY r, sg ORDER BY {key_sql("'p'", 'r', 'c')}, c) <= many AS f FROM k, range(1, {contrasts.REPLICATES + 1}) t(r)), n AS ({_CONTRAST.format('(SELECT r, p.f, e, n, y FROM p JOIN cell USING (c))')}),
s AS (SELECT r, f, {key_sql("'d'", '0', 'r', 'f::INT', 'place')} % m AS place FROM k, range(1, {contrasts.REPLICATES + 1}) t(r)), g AS ({_CONTRAST.format('(SELECT r, s.f, e, n, y FROM s JOIN k USING (f, place) JOIN cell USING (c))')})
SELECT round(any_value(o.d), 9) AS observed, round((1 + count(*) FILTER (WHERE abs(n.d) >= abs(o.d))) / {contrasts.REPLICATES + 1}.0e0, 9) AS p, (SELECT round(quantile_cont(d, 0.025), 9) FROM g) AS low, (SELECT round(quantile_cont(d, 0.5), 9) FROM g) AS median, (SELECT round(quantile_cont(d, 0.975), 9) FROM g) AS high,
(SELECT count(*) FROM k) AS channels, (SELECT count(*) FROM lineitem) AS units FROM n, o""")
def alignment_contrast(spark, d):
    """Whether two kinds of supplier differ in how well two profiles of their lines agree, return flags held fixed."""
    x = t(spark, d, "lineitem").select(
        "l_suppkey", "l_returnflag", F.array(F.col("l_quantity"), 1 + 100 * F.col("l_discount"), 1 + 100 * F.col("l_tax")).alias("p"),
        F.array(F.dayofmonth("l_shipdate").cast("double"), F.month("l_shipdate").cast("double"), F.col("l_linenumber").cast("double")).alias("q"),
    )
    r = contrasts.contrast(x, "l_suppkey", "l_returnflag", F.col("l_suppkey") % 2 == 0, contrasts.alignment(F.col("p"), F.col("q")))
    return r.withColumns({c: r9(c) for c in ("observed", "p", "low", "median", "high")})
