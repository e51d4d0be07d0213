"""Queries on sampling, inference, networks and series, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import stats
from threadloom.operators import inference, measurement, networks, timeseries
from threadloom.registry import day_events, pair_series, query, r9, t, trade_weights


def key_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


# Sampling

QUOTAS = {"en": 40, "de": 20, "fr": 20, "es": 10}


@query(f"""WITH q(lang, quota) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in QUOTAS.items())}), r AS (SELECT doc_id, lang, coalesce(quota, 0) AS quota, row_number() OVER (PARTITION BY lang ORDER BY {key_sql("'q'", 'doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents LEFT JOIN q USING (lang))
SELECT doc_id, lang, round(least(quota, n) / CAST(n AS DOUBLE), 9) AS p FROM r WHERE r <= quota""")
def stratified_sample(spark, d):
    return inference.stratified_sample(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", QUOTAS).withColumn("p", r9("p"))


@query("""WITH f AS (SELECT lang, count(*) AS k FROM documents GROUP BY lang)
SELECT doc_id, CASE WHEN lang <> 'en' THEN 'language' WHEN n_chars < 80 THEN 'short_or_contextual' WHEN contains(text, '@') OR k <= greatest(5, 0.1 * (SELECT count(*) FROM documents)) THEN 'rare' ELSE 'general' END AS stratum FROM documents JOIN f USING (lang)""")
def sampling_strata(spark, d):
    x = t(spark, d, "documents")
    rare = x.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).withColumn("rare", F.col("k") <= F.greatest(F.lit(5.0), 0.1 * F.sum("k").over(Window.partitionBy())))
    s = F.when(F.col("lang") != "en", "language").when(F.col("n_chars") < 80, "short_or_contextual").when(F.contains("text", F.lit("@")) | F.col("rare"), "rare").otherwise("general")
    return x.join(F.broadcast(rare), "lang").select("doc_id", s.alias("stratum"))  # a row a language


@query(f"""WITH b AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'foreign' WHEN n_chars > 5000 THEN 'long' END AS bucket FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {key_sql("'u'", 'doc_id')}, doc_id) AS r FROM b WHERE bucket IS NOT NULL) SELECT doc_id, bucket FROM r WHERE r <= 15""")
def bucket_sample(spark, d):
    x = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return inference.bucket_sample(x, "doc_id", {"short": F.col("n_chars") < 200, "foreign": F.col("lang") != "en", "long": F.col("n_chars") > 5000}, 15).select("doc_id", "bucket")


@query(f"""WITH x AS (SELECT p_partkey, p_brand, p_size, {key_sql("'d'", 'p_partkey')} % 10 = 0 AS drawn FROM part), s AS (SELECT *, sum(CASE WHEN drawn AND p_size > 20 THEN 1 ELSE 0 END) OVER w AS have, sum(CASE WHEN drawn THEN 1 ELSE 0 END) OVER w AS seen FROM x WINDOW w AS (PARTITION BY p_brand)),
r AS (SELECT *, ceil(greatest(12 - have, 0) / greatest(have / CAST(greatest(seen, 1) AS DOUBLE), 0.05)) AS wanted, row_number() OVER (PARTITION BY p_brand ORDER BY {key_sql("'t'", 'p_partkey')}, p_partkey) AS r FROM s WHERE NOT drawn) SELECT p_brand, p_partkey FROM r WHERE r <= wanted""")
def top_up_draw(spark, d):
    x = t(spark, d, "part").select("p_partkey", "p_brand", "p_size", (stats.stable_key(F.lit("d"), F.col("p_partkey")) % 10 == 0).alias("drawn"))
    return inference.top_up(x, "p_partkey", "p_brand", F.col("p_size") > 20, 12).select("p_brand", "p_partkey")


_THREADS = f"""WITH s AS (SELECT conv_id, CASE WHEN count(*) <= 3 THEN 'small' WHEN count(*) <= 6 THEN 'medium' ELSE 'large' END AS stratum FROM conversations GROUP BY conv_id), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {key_sql("'h'", 'conv_id')}, conv_id) AS r FROM s), c AS (SELECT conv_id, stratum FROM r WHERE r <= 8)"""


@query(f"{_THREADS} SELECT conv_id, turn, stratum FROM conversations JOIN c USING (conv_id)")
def thread_sample(spark, d):
    stratum = F.when(F.col("size") <= 3, "small").when(F.col("size") <= 6, "medium").otherwise("large")
    return inference.thread_sample(t(spark, d, "conversations"), "conv_id", stratum, 8).select("conv_id", "turn", "stratum")


@query(f"""{_THREADS}, n AS (SELECT conv_id, row_number() OVER (ORDER BY {key_sql("'r'", 'conv_id')}, conv_id) AS thread_label FROM c)
SELECT CAST(thread_label AS INTEGER) AS thread_label, CAST(row_number() OVER w AS INTEGER) AS node_label, CAST(CASE WHEN turn > 0 THEN row_number() OVER w - 1 END AS INTEGER) AS parent_label, role FROM conversations JOIN n USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def redacted_export(spark, d):
    return inference.redacted(thread_sample(spark, d).join(t(spark, d, "conversations"), ["conv_id", "turn"]), "conv_id", "turn", ["role"])


@query(f"""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, {key_sql("'f'", 'source')}, source) - 1 AS r FROM s)
SELECT source, n, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold FROM r""")
def grouped_folds(spark, d):
    return inference.grouped_folds(t(spark, d, "documents"), "source", 5)


# Inference

REPLICATES = 9_999


@query(f"""WITH s AS (SELECT o_orderpriority AS g, c_nationkey AS cl, sum(o_totalprice) AS y, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY cl) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM s),
d AS (SELECT g, r, {key_sql("'b'", 'g', 'r', 'i')} % m AS i FROM k, range(1, {REPLICATES + 1}) t(r)), b AS (SELECT d.g, r, sum(y) / sum(n) AS mean FROM d JOIN k ON k.g = d.g AND k.i = d.i GROUP BY ALL)
SELECT g, round(any_value(e), 4) AS estimate, any_value(c) AS clusters, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high FROM b JOIN (SELECT g, sum(y) / sum(n) AS e, count(*) AS c FROM s GROUP BY g) USING (g) GROUP BY g""")
def cluster_bootstrap(spark, d):
    x = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumnRenamed("o_orderpriority", "g")
    r4 = lambda c: F.round(c, 4).alias(c)
    return inference.cluster_bootstrap(x, ["g"], "c_nationkey", F.col("o_totalprice"), REPLICATES).select("g", r4("estimate"), "clusters", r4("low"), r4("high"))


@query(f"""WITH s AS (SELECT c_nationkey AS u, avg(c_acctbal - 4400) AS y FROM customer GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY u) - 1 AS i FROM s), d AS (SELECT r, {key_sql("'p'", 'r', 'i')} % (SELECT count(*) FROM k) AS i FROM k, range(1, {REPLICATES + 1}) t(r)), b AS (SELECT r, avg(y) AS m FROM d JOIN k USING (i) GROUP BY r)
SELECT round((SELECT avg(y) FROM s), 6) AS observed, round((1 + count(*) FILTER (WHERE m >= 2 * (SELECT avg(y) FROM s))) / {REPLICATES + 1}.0e0, 9) AS p FROM b""")
def bootstrap_p(spark, d):
    return inference.bootstrap_p(t(spark, d, "customer"), "c_nationkey", F.col("c_acctbal") - 4400, REPLICATES).select(F.round("observed", 6).alias("observed"), r9("p").alias("p"))


PERMUTATIONS = 199


@query(f"""WITH x AS (SELECT c_custkey, c_nationkey, c_mktsegment = 'BUILDING' AS l, c_acctbal AS y, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer), p AS (SELECT *, row_number() OVER (PARTITION BY r, c_nationkey ORDER BY {key_sql("'s'", 'r', 'c_custkey')}, c_custkey) AS place FROM x, range(1, {PERMUTATIONS + 1}) t(r)),
n AS (SELECT p.r, avg(CASE WHEN g.l THEN p.y END) - avg(CASE WHEN NOT g.l THEN p.y END) AS d FROM p JOIN x g ON g.c_nationkey = p.c_nationkey AND g.k = p.place GROUP BY p.r), o AS (SELECT avg(CASE WHEN l THEN y END) - avg(CASE WHEN NOT l THEN y END) AS d FROM x)
SELECT round(any_value(o.d), 6) AS observed, round((1 + count(*) FILTER (WHERE n.d >= o.d)) / {PERMUTATIONS + 1}.0e0, 9) AS p, round(median(n.d), 6) AS null_median FROM n, o""")
def stratified_permutation(spark, d):
    x = t(spark, d, "customer").withColumn("l", F.col("c_mktsegment") == "BUILDING")
    r = inference.stratified_permutation(x, "c_custkey", ["c_nationkey"], "l", "c_acctbal", PERMUTATIONS)
    return r.select(F.round("observed", 6).alias("observed"), r9("p").alias("p"), F.round("null_median", 6).alias("null_median"))


@query(f"""WITH x AS (SELECT p_size AS s, p_partkey AS u, p_retailprice AS y, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1 AS tr, count(*) OVER w AS m, sum(p_retailprice) OVER w AS tot FROM part WINDOW w AS (PARTITION BY p_size)), g AS (SELECT *, y - (tot - y) / (m - 1) AS gap FROM x WHERE m > 1),
o AS (SELECT avg(gap) AS d FROM g WHERE tr), q AS (SELECT r, s, gap, row_number() OVER (PARTITION BY r, s ORDER BY {key_sql("'m'", 'r', 'u')}, u) AS k FROM g, range(1, {PERMUTATIONS + 1}) t(r)), n AS (SELECT r, avg(gap) AS d FROM q WHERE k = 1 GROUP BY r)
SELECT round(any_value(o.d), 6) AS observed, round((1 + count(*) FILTER (WHERE n.d >= o.d)) / {PERMUTATIONS + 1}.0e0, 9) AS p FROM n, o""")
def matched_set_permutation(spark, d):
    w = Window.partitionBy("p_size")
    x = t(spark, d, "part").withColumn("tr", F.row_number().over(w.orderBy("p_partkey")) == 1).withColumn("m", F.count(F.lit(1)).over(w)).where("m > 1")
    return inference.matched_set_permutation(x, "p_size", "p_partkey", "tr", "p_retailprice", PERMUTATIONS).select(F.round("observed", 6).alias("observed"), r9("p").alias("p"))


@query("""WITH x AS (SELECT quality = 1 AS y, least(1.0e0, n_chars / 4000.0e0) AS s FROM documents JOIN labels USING (doc_id)), g AS (SELECT th AS threshold, count(*) FILTER (WHERE s >= th AND y) AS tp, count(*) FILTER (WHERE s >= th AND NOT y) AS fp, count(*) FILTER (WHERE s < th AND y) AS fn FROM x, (VALUES (0.3e0), (0.4e0), (0.5e0), (0.6e0), (0.7e0)) v(th) GROUP BY th),
f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END AS f1 FROM g) SELECT threshold, tp, fp, fn, round(f1, 9) AS f1, row_number() OVER (ORDER BY f1 DESC, abs(threshold - 0.5), threshold) = 1 AS best FROM f""")
def threshold_selection(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumn("s", F.least(F.lit(1.0), F.col("n_chars") / 4000.0))
    return inference.threshold_grid(x, "s", F.col("quality") == 1, [0.3, 0.4, 0.5, 0.6, 0.7]).withColumn("f1", r9("f1"))


@query("""WITH g AS (SELECT source, lang FROM (SELECT DISTINCT source FROM documents), (SELECT DISTINCT lang FROM documents)), c AS (SELECT source, lang, count(*) AS k FROM documents GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
x AS (SELECT source, lang, coalesce(k, 0) AS k, n, coalesce(k, 0) / CAST(n AS DOUBLE) AS p, 1.959963984540054e0 AS z FROM g JOIN n USING (source) LEFT JOIN c USING (source, lang))
SELECT source, lang, k, round(p, 9) AS share, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM x""")
def topic_prevalence(spark, d):
    x = t(spark, d, "documents")
    grid = x.select("source").distinct().crossJoin(F.broadcast(x.select("lang").distinct()))  # a row a language
    n, k = x.groupBy("source").agg(F.count(F.lit(1)).alias("n")), x.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("k"))
    g = grid.join(n, "source").join(k, ["source", "lang"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("source", "lang", "k", r9(F.col("k") / F.col("n")).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH c AS (SELECT c_nationkey, o_custkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), q AS (SELECT *, quantile_cont(n, 0.9) OVER (PARTITION BY c_nationkey) AS cut, row_number() OVER (PARTITION BY c_nationkey ORDER BY n, o_custkey) / CAST(count(*) OVER (PARTITION BY c_nationkey) AS DOUBLE) AS pct FROM c)
SELECT c_nationkey, round(any_value(cut), 6) AS cut, count(*) FILTER (WHERE n > cut) AS brokers, round(avg(CASE WHEN n > cut THEN n END), 6) AS broker_mean, round(avg(CASE WHEN n <= cut THEN n END), 6) AS other_mean, count(*) FILTER (WHERE pct > 0.9) AS top_ranked FROM q GROUP BY c_nationkey""")
def broker_evidence(spark, d):
    c = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c_nationkey")
    q = c.join(c.groupBy("c_nationkey").agg(F.percentile("n", 0.9).alias("cut")), "c_nationkey").withColumn("pct", F.row_number().over(w.orderBy("n", "o_custkey")) / F.count(F.lit(1)).over(w))
    high = F.col("n") > F.col("cut")
    return q.groupBy("c_nationkey").agg(F.round(F.first("cut"), 6).alias("cut"), F.count_if(high).alias("brokers"), F.round(F.avg(F.when(high, F.col("n"))), 6).alias("broker_mean"), F.round(F.avg(F.when(~high, F.col("n"))), 6).alias("other_mean"), F.count_if(F.col("pct") > 0.9).alias("top_ranked"))


@query()
def caliper_matching(spark, d):
    c = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spent"))
    w = Window.partitionBy("c_nationkey")
    rank = F.row_number().over(w.orderBy("n", "o_custkey")) / F.count(F.lit(1)).over(w)
    return inference.mahalanobis_caliper(c.withColumn("pct", rank), "o_custkey", "c_nationkey", F.col("pct") > 0.9, F.col("pct") <= 0.9, "n", "spent")


@query()
def quality_tfidf(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumn("fold", stats.stable_key(F.lit("fold"), F.col("doc_id")) % 3)
    return measurement.tfidf_logistic(x, "text", "quality", "fold", ["doc_id", "quality"])


# Networks

_TRADE = "SELECT o_custkey AS a, -(l_suppkey + 1) AS b, count(*) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"


def trade(spark, d):
    return trade_weights(spark, d).select("a", (-(F.col("b") + 1)).alias("b"), F.col("weight").alias("w"))


@query(f"""WITH e AS ({_TRADE}), v AS (SELECT a AS v, count(*) AS o, 0 AS i FROM e GROUP BY a UNION ALL SELECT b, 0, count(*) FROM e GROUP BY b)
SELECT count(*) AS nodes, sum(o)::BIGINT AS edges, sum(o) / (count(*) * (count(*) - 1.0e0)) AS density, max(o) AS max_out, max(i) AS max_in FROM v""")
def graph_density(spark, d):
    return networks.density(trade(spark, d), "a", "b")


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), p AS (SELECT a.conv_id, sum(b.turn - a.turn) AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn GROUP BY a.conv_id)
SELECT conv_id, n, CASE WHEN n < 2 THEN 0 ELSE s / (n * (n - 1) / 2.0e0) END AS virality FROM n LEFT JOIN p USING (conv_id)""")
def structural_virality(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"))
    return networks.tree_virality(c, "conv_id", "turn", "parent")


@query("""WITH p AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), q AS (SELECT *, (SELECT count(*) FROM p WHERE n > 1) AS m FROM p WHERE n > 1)
SELECT conv_id || ':' || turn AS node, turn * (n - 1 - turn) * 2.0e0 / ((m - 1.0e0) * (m - 2.0e0)) AS betweenness FROM q""")
def thread_betweenness(spark, d):
    c = t(spark, d, "conversations").where("turn > 0").select(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("a"), F.concat_ws(":", "conv_id", "turn").alias("b"))
    return networks.betweenness(c, "a", "b")


HITS_ROUNDS = 10
_HITS = f"WITH e AS (SELECT a, b FROM ({_TRADE})), h0 AS (SELECT DISTINCT a, 1.0e0 AS h FROM e)"
for _k in range(1, HITS_ROUNDS + 1):
    _HITS += f", g{_k} AS (SELECT b, sum(h) AS x FROM e JOIN h{_k - 1} USING (a) GROUP BY b), u{_k} AS (SELECT b, x / (SELECT sum(x) FROM g{_k}) AS u FROM g{_k}), f{_k} AS (SELECT a, sum(u) AS x FROM e JOIN u{_k} USING (b) GROUP BY a), h{_k} AS (SELECT a, x / (SELECT sum(x) FROM f{_k}) AS h FROM f{_k})"


@query(f"{_HITS} SELECT a AS node, round(h, 12) AS hub, 0.0e0 AS authority FROM h{HITS_ROUNDS} UNION ALL SELECT b, 0.0e0, round(u, 12) FROM u{HITS_ROUNDS}")
def hubs_and_authorities(spark, d):
    r = networks.hits(trade(spark, d), "a", "b", HITS_ROUNDS)
    return r.select("node", F.round("hub", 12).alias("hub"), F.round("authority", 12).alias("authority"))


_MEMBER = "SELECT c_custkey AS v, c_nationkey AS c FROM customer UNION ALL SELECT -(s_suppkey + 1), s_nationkey FROM supplier"


@query(f"""WITH e AS ({_TRADE}), m AS ({_MEMBER}), s AS (SELECT a AS v, b AS o, w FROM e UNION ALL SELECT b, a, w FROM e), k AS (SELECT s.v, m.c, sum(CASE WHEN m.c = n.c THEN w ELSE 0 END) AS k FROM s JOIN m ON m.v = s.v JOIN m n ON n.v = s.o GROUP BY ALL)
SELECT v AS node, c AS community, round(CASE WHEN stddev_pop(k) OVER p > 0 THEN (k - avg(k) OVER p) / stddev_pop(k) OVER p ELSE 0 END, 6) AS z FROM k WINDOW p AS (PARTITION BY c)""")
def module_z(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    s = t(spark, d, "supplier").select((-(F.col("s_suppkey") + 1)).alias("node"), F.col("s_nationkey").alias("community"))
    return networks.module_z(trade(spark, d), "a", "b", "w", c.unionByName(s)).withColumn("z", F.round("z", 6))


LABEL_ROUNDS = 4
_LABELS = f"WITH t AS ({_TRADE}), e AS (SELECT a AS u, b AS v, w FROM t UNION ALL SELECT b, a, w FROM t), l0 AS (SELECT DISTINCT u AS n, u AS l FROM e)"
for _k in range(LABEL_ROUNDS):
    _LABELS += f""", v{_k} AS (SELECT u, l, sum(w) AS w FROM (SELECT e.u, l, w FROM e JOIN l{_k} ON n = v UNION ALL SELECT n, l, 1 FROM l{_k}) GROUP BY ALL), b{_k} AS (SELECT u, l FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, l) AS r FROM v{_k}) WHERE r = 1),
 l{_k + 1} AS (SELECT n, CASE WHEN {key_sql("'l'", 'n')} % 2 = {_k % 2} THEN b{_k}.l ELSE l{_k}.l END AS l FROM l{_k} JOIN b{_k} ON u = n)"""


@query(f"{_LABELS} SELECT n AS node, min(n) OVER (PARTITION BY l) AS community FROM l{LABEL_ROUNDS}")
def label_communities(spark, d):
    return networks.propagated_communities(trade(spark, d), "a", "b", "w", LABEL_ROUNDS)


@query()
def nation_pagerank(spark, d):
    """Ranks that restart at the customers of one nation."""
    seeds = t(spark, d, "customer").where("c_nationkey = 1").select(F.col("c_custkey").alias("node"), F.lit(1.0).alias("mass"))
    e = trade(spark, d)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return networks.personalised_pagerank(both, "a", "b", "w", seeds)


@query()
def vote_rank(spark, d):
    return networks.vote_rank(trade(spark, d), "a", "b", 10)


# Series

@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM s),
m AS (SELECT h, y.v AS actual, x.v AS last, CASE WHEN k.day <= x.day THEN k.v ELSE x.v END AS naive FROM i x, (VALUES (1), (7)) q(h), i y LEFT JOIN i k ON k.day = y.day - 7 WHERE x.i >= 14 AND y.day = x.day + h)
SELECT CAST(h AS INTEGER) AS horizon, count(*) AS n, avg(abs(actual - naive)) AS naive_mae, sqrt(avg((actual - naive) ** 2)) AS naive_rmse, avg(abs(actual - last)) AS last_mae, sqrt(avg((actual - last) ** 2)) AS last_rmse FROM m GROUP BY h""")
def forecast_errors(spark, d):
    return timeseries.forecast_errors(day_events(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")), "day", "n", [1, 7], 14)


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS v FROM events GROUP BY 1), g AS (SELECT e.day AS event, avg(CASE WHEN s.day >= e.day THEN s.v END) - avg(CASE WHEN s.day < e.day THEN s.v END) AS step, count(*) AS n FROM s e JOIN s ON s.day BETWEEN e.day - 5 AND e.day + 4 GROUP BY 1)
SELECT event, round(step, 6) AS step FROM g WHERE n = 10""", dates=("event",))
def placebo_steps(spark, d):
    return timeseries.placebo_steps(day_events(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")), "day", "n", 5).withColumn("step", F.round("step", 6))


@query("""SELECT round(regr_slope(a, CAST(day - DATE '2024-01-01' AS DOUBLE)) FILTER (WHERE day < DATE '2024-01-15'), 6) AS pre_slope FROM (SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'view' THEN 1.0e0 ELSE 0 END) AS a FROM events GROUP BY 1)""")
def pre_trend(spark, d):
    at = F.datediff("day", F.lit("2024-01-01").cast("date")).cast("double")
    return pair_series(spark, d).where(F.col("day") < F.lit("2024-01-15").cast("date")).agg(F.round(F.regr_slope("a", at), 6).alias("pre_slope"))


@query("""SELECT event_type, count(*) AS points, count(*) - count(DISTINCT day) AS repeated, CAST(max(day) - min(day) + 1 - count(DISTINCT day) AS BIGINT) AS missing, round(avg(CASE WHEN v = 0 THEN 1.0e0 ELSE 0 END), 9) AS zero_share FROM (SELECT event_type, CAST(ts AS DATE) AS day, floor(value / 50) AS v FROM events) GROUP BY event_type""")
def series_audit(spark, d):
    x = day_events(spark, d).select("event_type", "day", F.floor(F.col("value") / 50).alias("v"))
    return timeseries.series_audit(x, "event_type", "day", "v").withColumn("zero_share", r9("zero_share"))


@query()
def segmented_trend(spark, d):
    s = day_events(spark, d).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    return timeseries.segmented_trend(s, "event_type", "day", "n", "2024-01-15")
