"""Queries on manual decisions, cluster resampling, series models and Unicode forms, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import unicode
from threadloom.operators import annotation, resampling, series_models
from threadloom.registry import day_events, pair_series, query, r9, t
from threadloom.registry_inference import REPLICATES, key_sql

# Manual decisions

_CODED = """SELECT doc_id, source AS thing, 'd_' || doc_id AS key, lang, n_chars, text FROM documents"""
_DECIDED = """SELECT source AS thing, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'd_' || doc_id END AS key, CASE WHEN quality = 0 THEN 'exclude' WHEN lang = 'en' THEN 'english' ELSE 'non_english' END AS value FROM documents JOIN labels USING (doc_id)"""


def coded(spark, d):
    return t(spark, d, "documents").select("doc_id", F.col("source").alias("thing"), F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("key"), "lang", "n_chars", "text")


def decided(spark, d):
    x, own = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id"), F.col("doc_id").cast("string")
    value = F.when(F.col("quality") == 0, "exclude").when(F.col("lang") == "en", "english").otherwise("non_english")
    return x.select(F.col("source").alias("thing"), F.when(F.col("doc_id") % 3 == 0, own).otherwise(F.concat(F.lit("d_"), own)).alias("key"), value.alias("value"))


@query(f"""WITH r AS ({_CODED}), o AS (SELECT thing, key, max(value) AS value FROM ({_DECIDED}) GROUP BY ALL)
SELECT doc_id, coalesce(a.value, b.value, '') AS override, status = 'language_uncertain' AND s AS review, s AND status = 'eligible' AND lang = 'en' AND coalesce(a.value, b.value, '') NOT IN ('exclude', 'non_english') AS strict,
coalesce(a.value, b.value, '') NOT IN ('exclude', 'non_english') AND s AND ((status = 'eligible' AND lang = 'en') OR status = 'language_uncertain' OR coalesce(a.value, b.value, '') = 'english') AS inclusive
FROM (SELECT *, CASE WHEN n_chars < 200 THEN 'language_uncertain' ELSE 'eligible' END AS status, coalesce(trim(text), '') <> '' AS s FROM r) r LEFT JOIN o a ON a.thing = r.thing AND a.key = r.key LEFT JOIN o b ON b.thing = r.thing AND b.key = substr(r.key, 3)""")
def manual_overrides(spark, d):
    x = annotation.apply_overrides(coded(spark, d), decided(spark, d), "thing", "key", F.lit("d_"))
    status = F.when(F.col("n_chars") < 200, "language_uncertain").otherwise("eligible")
    masks = annotation.eligibility(status, F.col("lang") == "en", F.coalesce(F.trim("text") != "", F.lit(False)), F.col("override"))
    return x.select("doc_id", F.coalesce("override", F.lit("")).alias("override"), *[m.alias(k) for k, m in masks.items()])


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'open' ELSE p_brand END AS settled, concat_ws('|', CASE WHEN p_size % 4 = 0 THEN 'even' END, CASE WHEN p_brand LIKE '%1' THEN 'one' END, CASE WHEN p_size < 25 THEN 'small' END) AS labels FROM part""")
def merged_coders(spark, d):
    """Two coders that differ on 'even' for some sizes and on 'small' for others; 'small' was settled before."""
    size, one = F.col("p_size"), F.when(F.endswith("p_brand", F.lit("1")), "one")
    a, b = (F.array_compact(F.array(F.when(size % k == 0, "even"), one, F.when(size < s, "small"))) for k, s in ((2, 20), (4, 25)))
    x = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("a"), F.when(size % 3 == 0, "other").otherwise(F.col("p_brand")).alias("b"), F.lit("open").alias("before"), a.alias("sa"), b.alias("sb"))
    labels = annotation.merge_label_sets(F.col("sa"), F.col("sb"), F.array(F.lit("small")), ["even", "one", "small"])
    return x.select("p_partkey", annotation.merge_coders("a", "b", "before").alias("settled"), F.concat_ws("|", labels).alias("labels"))


@query("""WITH x AS (SELECT 'quality' AS label, least(1.0e0, n_chars / 4000.0e0) AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', 1 - least(1.0e0, n_chars / 4000.0e0), toxic = 1 FROM documents JOIN labels USING (doc_id)),
g AS (SELECT label, th AS threshold, count(*) FILTER (WHERE s >= th AND y) AS tp, count(*) FILTER (WHERE s >= th AND NOT y) AS fp, count(*) FILTER (WHERE s < th AND y) AS fn FROM x, (VALUES (0.3e0), (0.4e0), (0.5e0), (0.6e0), (0.7e0)) v(th) GROUP BY ALL),
f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END AS f1 FROM g)
SELECT label, threshold, tp, fp, fn, round(f1, 9) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, abs(threshold - 0.5), threshold) = 1""")
def label_thresholds(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    s = F.least(F.lit(1.0), F.col("n_chars") / 4000.0)
    return annotation.label_thresholds(x, {"quality": (s, F.col("quality") == 1), "toxic": (1 - s, F.col("toxic") == 1)}, [0.3, 0.4, 0.5, 0.6, 0.7]).withColumn("f1", r9("f1"))


@query()
def topic_alignment(spark, d):
    """Brands of small and of large parts, each with the ten types that it has most of, laid side by side."""
    c = t(spark, d, "part").groupBy((F.col("p_size") > 25).alias("large"), "p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("large", "p_brand").orderBy(F.desc("n"), "p_type")
    top = c.withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("large", "p_brand").agg(F.collect_set("p_type").alias("terms"))  # ten a brand
    return annotation.topic_assignment(top.where("NOT large"), top.where("large"), "p_brand", "terms")


# Resampling

@query(f"""WITH x AS (SELECT o_orderpriority AS k, c_nationkey AS cl, o_custkey AS u, CASE WHEN o_totalprice > 150000 THEN 1.0e0 ELSE 0 END AS y FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority IN ('5-LOW', '1-URGENT')),
s AS (SELECT k, cl, sum(y) AS y, count(*) AS n FROM (SELECT k, cl, u, avg(y) AS y FROM x GROUP BY ALL) GROUP BY ALL), o AS (SELECT avg(CASE WHEN k = '5-LOW' THEN y END) - avg(CASE WHEN k = '1-URGENT' THEN y END) AS observed FROM (SELECT k, u, avg(y) AS y FROM x GROUP BY ALL)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cl) - 1 AS i, count(*) OVER (PARTITION BY k) AS m FROM s), w AS (SELECT k, j, {key_sql("'h'", 'k', 'j', 'i')} % m AS i FROM r, range(1, {REPLICATES + 1}) q(j)),
b AS (SELECT j, w.k, sum(y) / sum(n) AS m FROM w JOIN r ON r.k = w.k AND r.i = w.i GROUP BY ALL), e AS (SELECT j, sum(CASE WHEN k = '5-LOW' THEN m END) - sum(CASE WHEN k = '1-URGENT' THEN m END) AS d FROM b GROUP BY j)
SELECT round(any_value(observed), 6) AS observed, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.975), 6) AS high, round((1 + count(*) FILTER (WHERE d >= 2 * observed)) / {REPLICATES + 1}.0e0, 9) AS p FROM e, o""")
def thread_bootstrap(spark, d):
    x = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    r = resampling.thread_bootstrap_difference(x, "o_orderpriority", "5-LOW", "1-URGENT", "c_nationkey", "o_custkey", F.col("o_totalprice") > 150000, REPLICATES)
    return r.select(*[F.round(c, 6).alias(c) for c in ("observed", "low", "median", "high")], r9("p").alias("p"))


@query(f"""WITH x AS (SELECT c_nationkey AS cl, c_mktsegment AS a, CASE WHEN c_acctbal < 3000 THEN 'BUILDING' WHEN c_acctbal < 6000 THEN 'MACHINERY' ELSE c_mktsegment END AS p FROM customer),
c AS (SELECT cl, l, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT cl, a AS l, CAST(a = p AS INT) AS tp, 0 AS fp, CAST(a <> p AS INT) AS fn FROM x UNION ALL SELECT cl, p, 0, 1, 0 FROM x WHERE a <> p) GROUP BY ALL),
k AS (SELECT cl, row_number() OVER (ORDER BY cl) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT cl FROM x)), w AS (SELECT j, {key_sql("'c'", 'j', 'i')} % m AS i FROM k, range(1, {REPLICATES + 1}) q(j)),
f AS (SELECT j, l, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE AS f FROM w JOIN k USING (i) JOIN c USING (cl) GROUP BY ALL), b AS (SELECT j, avg(f) AS f FROM f GROUP BY j), o AS (SELECT avg(f) AS f FROM (SELECT l, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE AS f FROM c GROUP BY l))
SELECT round((SELECT f FROM o), 6) AS macro_f1, round(quantile_cont(f, 0.025), 6) AS low, round(quantile_cont(f, 0.5), 6) AS median, round(quantile_cont(f, 0.975), 6) AS high FROM b""")
def macro_f1_interval(spark, d):
    guess = F.when(F.col("c_acctbal") < 3000, "BUILDING").when(F.col("c_acctbal") < 6000, "MACHINERY").otherwise(F.col("c_mktsegment"))
    r = resampling.macro_f1_bootstrap(t(spark, d, "customer"), "c_nationkey", F.col("c_mktsegment"), guess, REPLICATES)
    return r.select(*[F.round(c, 6).alias(c) for c in ("macro_f1", "low", "median", "high")])


@query()
def power_of_means(spark, d):
    return resampling.power_diagnostic(t(spark, d, "customer"), "c_mktsegment", F.col("c_acctbal"), 100.0)


# Series

def daily_counts(spark, d):
    return day_events(spark, d).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))


@query()
def series_change_points(spark, d):
    return series_models.change_points(daily_counts(spark, d), "event_type", "day", "n", 3.0)


@query()
def lag_tests(spark, d):
    return series_models.lag_test(pair_series(spark, d).withColumn("pair", F.lit("a from b")), "pair", "day", "a", "b")


@query()
def lag_forecasts(spark, d):
    return series_models.lag_forecasts(daily_counts(spark, d), "event_type", "day", "n", 14)


# Unicode

@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def composed_text(spark, d):
    return t(spark, d, "documents").select("doc_id", unicode.normal_form(F.col("text"), "NFC").alias("text"))


@query()
def folded_hashes(spark, d):
    return t(spark, d, "documents").select("doc_id", unicode.text_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query(r"""SELECT n_nationkey, h AS header, CASE WHEN regexp_matches(h, 'new zealand|\bnz\b') THEN 'NZ' WHEN regexp_matches(h, 'united kingdom|vuong quoc anh|\buk\b') THEN 'UK' WHEN regexp_matches(h, 'australia|(^|[^a-z])uc([^a-z]|$)|\bau\b') THEN 'AU' WHEN regexp_matches(h, 'ireland|\bie\b') THEN 'IE' END AS country,
CASE WHEN n_nationkey % 5 = 0 THEN 0.5e0 ELSE n_nationkey * 1000 + 0.5e0 END AS value FROM (SELECT n_nationkey, strip_accents(lower(trim(n_name))) AS h FROM nation)""")
def headers_and_values(spark, d):
    h = unicode.folded_header(F.col("n_name"))
    cell = F.when(F.col("n_nationkey") % 5 == 0, " <1").otherwise(F.concat(F.format_number(F.col("n_nationkey") * 1000 + 0.5, 1), F.lit("%")))
    return t(spark, d, "nation").select("n_nationkey", h.alias("header"), unicode.country(h).alias("country"), unicode.trend_value(cell).alias("value"))
