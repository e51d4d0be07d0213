"""Queries of the engine's own operators on the standard tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import stats, text
from threadloom.operators import aggregates, graph, joins, timeseries, windows
from threadloom.plans.fixpoint import shared_folder
from threadloom.sources import files
from threadloom.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; columns in ``dates`` leave both engines as ISO text."""

    def add(f: Query) -> Query:
        name = f.__name__
        _QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("string") for c in dates})) if dates else f
        if sql:
            _SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return add


def _all() -> None:
    from threadloom import registry_annotation, registry_corpus, registry_inference, registry_structure  # noqa: F401, PLC0415 - they register their queries here


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r9(c):
    return F.round(c, 9)


KEY_SQL = "('0x' || substr(md5({}), 1, 15))::BIGINT"
WINDOWS = [("w1", "2024-01-01", "2024-01-11"), ("w2", "2024-01-11", "2024-01-21"), ("w3", "2024-01-21", "2024-01-31")]
WINDOWS_SQL = "(VALUES ('w1', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-11'), ('w2', TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-21'), ('w3', TIMESTAMP '2024-01-21', TIMESTAMP '2024-01-31')) AS w(scope, s, e)"
CALENDAR = [("E1", "2024-01-05"), ("E2", "2024-01-15"), ("E3", "2024-01-25")]
EVENTS_DAY = "SELECT *, CAST(ts AS DATE) AS day FROM events"


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(WINDOWS, "scope string, s string, e string").select("scope", F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))
    return joins.in_window(t(spark, sf_dir, "events"), F.col("ts"), dim)


def day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


# Windows, shares, concentration

@query(f"""
WITH x AS (SELECT w.scope, user_id, event_type FROM events, {WINDOWS_SQL} WHERE ts >= s AND ts < e),
a AS (SELECT scope, user_id, sum(CASE WHEN event_type = 'purchase' THEN 1.0e0 ELSE 0.0e0 END) AS h, count(*) AS n FROM x GROUP BY ALL),
b AS (SELECT scope, sum(h) / sum(n) AS document_share, avg(h / n) AS author_share, count(*) AS authors FROM a GROUP BY scope),
c AS (SELECT scope, user_id, n, n * 1.0e0 / sum(n) OVER (PARTITION BY scope) AS share, row_number() OVER (PARTITION BY scope ORDER BY n DESC, user_id) AS rn FROM a),
d AS (SELECT scope, max(share) AS top1, sum(CASE WHEN rn <= 10 THEN share ELSE 0 END) AS top10, 1 / sum(share * share) AS eff FROM c GROUP BY scope)
SELECT b.scope, round(document_share, 9) AS document_share, round(author_share, 9) AS author_share, authors, round(top1, 9) AS top1_share, round(top10, 9) AS top10_share, round(eff, 6) AS effective_n FROM b JOIN d USING (scope)""")
def event_window_share(spark, d):
    x = windowed_events(spark, d)
    share = aggregates.balanced_share(x, ["scope"], "user_id", F.col("event_type") == "purchase")
    top = aggregates.concentration(x, ["scope"], "user_id")
    return share.join(top, "scope").select("scope", r9("document_share").alias("document_share"), r9("author_share").alias("author_share"), "authors", r9("top1_share").alias("top1_share"), r9("top10_share").alias("top10_share"), F.round("effective_n", 6).alias("effective_n"))


@query("""
WITH c AS (SELECT c_nationkey, o_custkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
s AS (SELECT *, n * 1.0e0 / sum(n) OVER (PARTITION BY c_nationkey) AS share, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, o_custkey) AS rn FROM c)
SELECT c_nationkey, count(*) AS entities, round(max(share), 9) AS top1_share, round(sum(CASE WHEN rn <= 10 THEN share ELSE 0 END), 9) AS top10_share, round(1 / sum(share * share), 6) AS effective_n FROM s GROUP BY c_nationkey""")
def customer_concentration(spark, d):
    x = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return aggregates.concentration(x, ["c_nationkey"], "o_custkey").select("c_nationkey", "entities", r9("top1_share").alias("top1_share"), r9("top10_share").alias("top10_share"), F.round("effective_n", 6).alias("effective_n"))


@query(f"""
WITH d AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events), c(name, w) AS (VALUES ('E1', DATE '2024-01-05'), ('E2', DATE '2024-01-15'), ('E3', DATE '2024-01-25')),
r AS (SELECT event_id, name, day - w AS off, row_number() OVER (PARTITION BY event_id ORDER BY abs(day - w), w) AS rn FROM d, c)
SELECT event_id, name AS nearest, CAST(off AS INTEGER) AS offset_days FROM r WHERE rn = 1""")
def nearest_event(spark, d):
    cal = spark.createDataFrame(CALENDAR, "name string, w string").select("name", F.to_date("w").alias("w"))
    return joins.nearest(day_events(spark, d), "event_id", F.col("day"), cal, "w", "name").select("event_id", "nearest", "offset_days")


@query("""
WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT event_type, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM c GROUP BY event_type),
s AS (SELECT event_type, day, n, CASE WHEN n IS NULL THEN 'missing' WHEN n < 20 THEN 'thin' ELSE 'supported' END AS status FROM g LEFT JOIN c USING (event_type, day))
SELECT event_type, day, n, status, avg(CASE WHEN status <> 'supported' THEN 1.0e0 ELSE 0.0e0 END) OVER (PARTITION BY event_type) > 1.0e0 / 3 AS weekly FROM s""", dates=("day",))
def daily_timeline(spark, d):
    return aggregates.support_status(aggregates.dense_days(day_events(spark, d), F.col("day"), ["event_type"]), ["event_type"])


@query("""
WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT event_id) AS n FROM events GROUP BY ALL HAVING count(DISTINCT event_id) >= 3),
b AS (SELECT day, CASE WHEN max(n) < 90 THEN sum(n) END AS base FROM s GROUP BY day)
SELECT event_type, day, n, round(10000.0e0 * n / base, 4) AS per_10k FROM s JOIN b USING (day)""", dates=("day",))
def normalised_series(spark, d):
    s = day_events(spark, d).groupBy("event_type", "day").agg(F.countDistinct("event_id").alias("n")).where("n >= 3")
    return timeseries.normalised(s, "event_type", "day", "n", 90).select("event_type", "day", "n", "per_10k")


@query("""
WITH x AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT a.user_id, a.event_type, a.day,
 sum(CASE WHEN b.day >= a.day AND b.day < a.day + 7 THEN b.n ELSE 0 END) AS w0, sum(CASE WHEN b.day >= a.day + 7 AND b.day < a.day + 14 THEN b.n ELSE 0 END) AS w1
 FROM x a JOIN x b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY ALL)
SELECT user_id, event_type, min(day) AS uptake FROM w WHERE w0 >= 3 AND w1 >= 3 GROUP BY ALL""", dates=("uptake",))
def sustained_uptake(spark, d):
    return windows.sustained(day_events(spark, d), ["user_id", "event_type"], "day")


@query("""
WITH g AS (SELECT unnest(generate_series(-7, 10)) AS off), c AS (SELECT CAST(CAST(ts AS DATE) - DATE '2024-01-15' AS BIGINT) AS off, count(*) AS n FROM events GROUP BY ALL)
SELECT CAST(g.off AS INTEGER) AS offset_days, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.off = g.off""")
def reaction_curve(spark, d):
    c = day_events(spark, d).groupBy(F.datediff("day", F.lit("2024-01-15").cast("date")).alias("offset_days")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(-7, 11).select(F.col("id").cast("int").alias("offset_days")).join(c, "offset_days", "left").select("offset_days", F.coalesce("n", F.lit(0)).alias("n"))


_PAIR_SERIES = "SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'view' THEN 1.0e0 ELSE 0 END) AS a, sum(CASE WHEN event_type = 'click' THEN 1.0e0 ELSE 0 END) AS b FROM events GROUP BY ALL"


def pair_series(spark, d):
    one = lambda k: F.sum(F.when(F.col("event_type") == k, 1.0).otherwise(0.0))
    return day_events(spark, d).groupBy("day").agg(one("view").alias("a"), one("click").alias("b"))


@query(f"""
WITH s AS ({_PAIR_SERIES}), d AS (SELECT day, a - lag(a) OVER w AS x, b - lag(b) OVER w AS y FROM s WINDOW w AS (ORDER BY day)),
f AS (SELECT * FROM d WHERE x IS NOT NULL), e AS (SELECT *, lag(x) OVER (ORDER BY day) AS px, lag(y) OVER (ORDER BY day) AS py FROM f),
p AS (SELECT sum(x * px) / sum(px * px) AS phi FROM e WHERE px IS NOT NULL),
r AS (SELECT row_number() OVER (ORDER BY day) AS i, x - phi * px AS u, y - phi * py AS v FROM e, p WHERE px IS NOT NULL)
SELECT CAST(l AS INTEGER) AS lag, round(CASE WHEN count(*) >= 3 THEN corr(q.u, z.v) END, 6) AS r, count(*) AS n FROM r q, generate_series(-7, 7) g(l), r z WHERE z.i = q.i - l GROUP BY l""")
def lag_correlation(spark, d):
    return timeseries.lag_correlation(pair_series(spark, d), "day", "a", "b", 7).select("lag", F.round("r", 6).alias("r"), "n")


@query("""
WITH n AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events))
SELECT a.day AS cutoff, CAST(h AS INTEGER) AS horizon, b.day AS target, CAST(a.i AS INTEGER) AS train_days FROM n a, (VALUES (1), (7)) v(h), n b WHERE a.i >= 14 AND b.i = a.i + h""", dates=("cutoff", "target"))
def rolling_origins(spark, d):
    return timeseries.rolling_origins(day_events(spark, d), "day", [1, 7], train=14)


@query("""
WITH s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT day, n, lag(n, 7) OVER (ORDER BY day) AS forecast FROM s)
SELECT day, n, forecast, abs(n - forecast) AS error FROM f""", dates=("day",))
def seasonal_naive(spark, d):
    s = day_events(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return timeseries.rolling_naive(s, "day", "n", 7)


@query("""
WITH x AS (SELECT day, event_type, k AS win, count(*) * (1.0e0 + 0.5e0 * max(k)) AS v FROM (SELECT CAST(ts AS DATE) AS day, event_type FROM events) e, (VALUES (0), (1), (2)) w(k)
 WHERE day >= DATE '2024-01-01' + 7 * k AND day < DATE '2024-01-01' + 7 * k + 14 GROUP BY ALL)
SELECT b.win, round(median(a.v / b.v), 9) AS factor, count(*) AS pairs FROM x a JOIN x b ON b.win = a.win + 1 AND a.day = b.day AND a.event_type = b.event_type WHERE a.v > 0 AND b.v > 0 GROUP BY b.win""")
def trend_overlap_factors(spark, d):
    e = day_events(spark, d).select("day", "event_type", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("win"))
    first = F.date_add(F.lit("2024-01-01").cast("date"), F.col("win") * 7)
    x = e.where((F.col("day") >= first) & (F.col("day") < F.date_add(first, 14))).groupBy("day", "event_type", "win").agg((F.count(F.lit(1)) * (1.0 + 0.5 * F.first("win"))).alias("v"))
    return timeseries.overlap_factors(x, "win", ["day", "event_type"], "v").select("win", r9("factor").alias("factor"), "pairs")


# Text

@query("""
WITH k AS (SELECT doc_id, sha256(lower(text)) AS h FROM documents)
SELECT doc_id, h AS text_hash, count(*) OVER (PARTITION BY h) AS duplicate_text_count, count(*) OVER (PARTITION BY h) > 1 AS is_exact_duplicate, row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS is_first FROM k""")
def exact_duplicate_flags(spark, d):
    k = t(spark, d, "documents").select("doc_id", text.digest_casefold(F.col("text")).alias("text_hash"))
    w = Window.partitionBy("text_hash")
    n = F.count(F.lit(1)).over(w)
    return k.select("doc_id", "text_hash", n.alias("duplicate_text_count"), (n > 1).alias("is_exact_duplicate"), (F.row_number().over(w.orderBy("doc_id")) == 1).alias("is_first"))


_BITS = ", ".join(f"sum(CASE WHEN (p{b // 32} >> {b % 32}) & 1 = 1 THEN 1 ELSE -1 END) AS s{b}" for b in range(64))
_BANDS = ", ".join(" + ".join(f"(CASE WHEN s{16 * i + b} > 0 THEN {1 << b} ELSE 0 END)" for b in range(16)) + f" AS b{i}" for i in range(4))
_GAP = " + ".join(f"bit_count(xor(a.b{i}::INTEGER, b.b{i}::INTEGER))" for i in range(4))


@query(f"""
WITH f AS (SELECT min(doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY lower(text)),
k AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM f),
v AS (SELECT doc_id, md5(unnest(w)) AS h FROM k WHERE len(w) >= 5),
p AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT AS p0, ('0x' || substr(h, 9, 8))::BIGINT AS p1 FROM v),
s AS (SELECT doc_id, {_BITS} FROM p GROUP BY doc_id), n AS (SELECT doc_id, {_BANDS} FROM s)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, CAST({_GAP} AS INTEGER) AS distance FROM n a JOIN n b ON a.doc_id < b.doc_id WHERE {_GAP} <= 3""")
def simhash_near_duplicates(spark, d):
    # equal texts have equal bands, so a text's digest stands for it; texts are dealt to tasks once, and never grouped or sorted
    low = F.lower("text")
    rows = t(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.sha2(low, 256).alias("digest"), text.words(low).alias("w")).where(F.size("w") >= 5)
    first = joins.simhash_bands(rows, "doc_id", "digest", tokens="w").groupBy("digest").agg(F.min(F.struct("doc_id", *[f"b{i}" for i in range(4)])).alias("first"))
    return joins.simhash_pairs(first.select("first.*"), "doc_id")


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '(?:https?://|www\.)[^\s]+', '<URL>', 'g'), '\+?[0-9][0-9 ()-]{7,}[0-9]', '<PHONE>', 'g'), '(^|[^A-Za-z0-9_])@[A-Za-z0-9_]{2,}', '\1<USER>', 'g')) AS masked_md5,
 len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::INTEGER AS emails, len(regexp_extract_all(text, '\+?[0-9][0-9 ()-]{7,}[0-9]'))::INTEGER AS phones FROM documents""")
def pii_mask(spark, d):
    x = t(spark, d, "documents")
    c = text.mask_counts(F.col("text"))
    return x.select("doc_id", F.md5(text.masked(F.col("text"))).alias("masked_md5"), c["emails"].alias("emails"), c["phones"].alias("phones"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, 'https?://[^\s"<>]+'))::INTEGER AS urls, regexp_matches(regexp_replace(html, '<[^>]*>', '', 'g'), '[A-Za-z]') AS has_letters FROM pages""")
def url_flags(spark, d):
    x = t(spark, d, "pages")
    return x.select("page_id", F.regexp_count("html", F.lit(r'https?://[^\s"<>]+')).alias("urls"), F.regexp_replace("html", "<[^>]*>", "").rlike("[A-Za-z]").alias("has_letters"))


@query(r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\s+', ' ', 'g'))) AS clean_md5 FROM pages""")
def html_clean_light(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(text.clean_light(F.col("html"))).alias("clean_md5"))


@query(r"""
SELECT doc_id, sha256(lower(text)) AS digest, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS duplicate_key, md5(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS folded_md5 FROM documents""")
def text_digests(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", text.digest_casefold(c).alias("digest"), text.duplicate_key(c).alias("duplicate_key"), F.md5(F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))).alias("folded_md5"))


GROUPS = {"policy": ["licensed", "license", "version"], "safety": ["password", "secret", "token"], "privacy": ["email", "phone"], "common": ["the", "that"]}


def _term_sql(term: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


_FIRE = {g: "(" + " OR ".join(_term_sql(x) for x in terms) + ")" for g, terms in GROUPS.items()}


@query(f"""
WITH f AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _FIRE.items())}, {_term_sql('und')} AS ctx FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN policy THEN 'policy' END, CASE WHEN safety AND (policy OR ctx) THEN 'safety' END, CASE WHEN privacy AND (policy OR ctx) THEN 'privacy' END, CASE WHEN common AND (policy OR ctx) THEN 'common' END], lambda x: x IS NOT NULL), '|') AS frames FROM f""")
def lexicon_frames_gated(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(text.lexicon_groups(F.col("text"), GROUPS, "policy", ["und"]), "|").alias("frames"))


@query("""SELECT doc_id, regexp_matches(lower(text), '(licensed)[\\s\\S]{0,80}?(version)|(version)[\\s\\S]{0,80}?(licensed)') AS near FROM documents""")
def proximity_detector(spark, d):
    return t(spark, d, "documents").select("doc_id", text.near_each_other(F.col("text"), "licensed", "version").alias("near"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '(licensed|password|license|version|the)'))), '|') AS hits FROM documents""")
def term_hits(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(text.distinct_hits(F.col("text"), ["password", "license", "licensed", "version", "the"]), "|").alias("hits"))


@query(r"""
WITH q(phrase) AS (VALUES ('licensed under'), ('version 2 0'))
SELECT phrase, count(*) FILTER (WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || phrase || ' ')) AS exact_hits,
 count(*) FILTER (WHERE list_bool_and(list_transform(string_split(phrase, ' '), lambda x: contains(lower(text), x)))) AS all_term_hits FROM documents, q GROUP BY phrase""")
def phrase_matches(spark, d):
    q = F.explode(F.array(F.lit("licensed under"), F.lit("version 2 0"))).alias("phrase")
    x = t(spark, d, "documents").select("text", q)
    return x.groupBy("phrase").agg(F.count_if(text.phrase_exact(F.col("text"), F.col("phrase"))).alias("exact_hits"), F.count_if(text.all_terms(F.col("text"), F.col("phrase"))).alias("all_term_hits"))


@query("""SELECT conv_id, turn, CASE WHEN trim(text) = '' OR text IS NULL THEN 'empty' WHEN lower(trim(text)) = '[deleted]' THEN 'deleted' WHEN lower(trim(text)) = '[removed]' THEN 'removed' ELSE 'eligible' END AS status FROM conversations""")
def text_presence(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", text.presence(F.col("text")).alias("status"))


@query(r"""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT starts_with(ltrim(l), '>')), chr(10))) AS unquoted_md5 FROM documents""")
def quoted_lines(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.without_quotes(F.col("text"))).alias("unquoted_md5"))


@query(r"""SELECT 'documents' AS source, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS leaks, count(*) AS n FROM documents
UNION ALL SELECT 'conversations', count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')), count(*) FROM conversations""")
def identifier_audit(spark, d):
    one = lambda name: t(spark, d, name).agg(F.count_if(F.col("text").rlike(text.EMAIL)).alias("leaks"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "leaks", "n")
    return one("documents").unionByName(one("conversations"))


# Threads and graphs

_REPLY = "SELECT c.conv_id, c.turn, c.role AS source, p.role AS target FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1 WHERE c.role <> p.role"


def replies(spark, d):
    c = t(spark, d, "conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("target"))
    return c.select("conv_id", "turn", F.col("role").alias("source")).join(p, ["conv_id", "turn"]).where("source <> target")


@query(f"SELECT conv_id, turn, source, target FROM ({_REPLY})")
def reply_edges(spark, d):
    return replies(spark, d).select("conv_id", "turn", "source", "target")


@query(f"SELECT source, target, count(*) AS weight, min(conv_id) AS first_day, max(conv_id) AS last_day FROM ({_REPLY}) GROUP BY source, target")
def reply_actor_edges(spark, d):
    return graph.actor_edges(replies(spark, d), "source", "target", [], "conv_id")


@query(f"WITH e AS (SELECT DISTINCT source, target FROM ({_REPLY})) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.source = a.target AND b.target = a.source)) AS mutual")
def reply_reciprocity(spark, d):
    return graph.reciprocity(replies(spark, d).select("source", "target").distinct(), "source", "target")


@query("""SELECT conv_id, count(*) AS documents, count(*) - 1 AS edges, count(DISTINCT role) AS roles, max(turn) AS depth, max(n) AS breadth FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM conversations) GROUP BY conv_id""")
def cascade_summary(spark, d):
    c = t(spark, d, "conversations").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id", "turn")))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("documents"), (F.count(F.lit(1)) - 1).alias("edges"), F.countDistinct("role").alias("roles"), F.max("turn").alias("depth"), F.max("n").alias("breadth"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_assistant FROM conversations""")
def handle_last_before(spark, d):
    return joins.last_before(t(spark, d, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "assistant", F.col("turn")), "last_assistant").select("conv_id", "turn", "last_assistant")


@query(f"""WITH n AS (SELECT source, target, count(*) AS n FROM ({_REPLY}) GROUP BY ALL)
SELECT source, target, n, round(n * 1.0e0 / sum(n) OVER (PARTITION BY source), 9) AS row_share, round(n * 1.0e0 / sum(n) OVER (), 9) AS overall_share FROM n""")
def frame_transitions(spark, d):
    n = replies(spark, d).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "target", "n", r9(F.col("n") / F.sum("n").over(Window.partitionBy("source"))).alias("row_share"), r9(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("overall_share"))


def trade_weights(spark, d):
    """``a`` (customer), ``b`` (supplier), ``weight`` (lines) and ``containers`` (orders) of each pair that trades. An order's lines shrink to a
    row a supplier where they meet the order, so no set of orders is kept; tables are spread over tasks by their rows, so that a task
    holds no more of a larger table."""
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    parts = joins.parts_of(t(spark, d, "lineitem"))
    orders = joins.spread(t(spark, d, "orders").select("o_orderkey", "o_custkey"), parts, "o_orderkey")
    met = orders.join(joins.spread(lines, parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    once = met.groupBy("o_orderkey", F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return joins.spread(once.select("a", "b", "n"), parts, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("containers"))


_CO = "SELECT DISTINCT o_custkey AS a, -(l_suppkey + 1) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def co_edges(spark, d):
    return trade_weights(spark, d).select("a", (-(F.col("b") + 1)).alias("b"))


@query(f"""
WITH RECURSIVE e AS ({_CO}), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS n, x AS m FROM u UNION SELECT u.y, r.m FROM r JOIN u ON u.x = r.n)
SELECT component, count(*) AS nodes FROM (SELECT n, min(m) AS component FROM r GROUP BY n) GROUP BY component""")
def component_sizes(spark, d):
    return graph.component_sizes(co_edges(spark, d))


@query("""SELECT conv_id || ':' || turn AS node, CAST(turn AS INTEGER) AS depth FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1)""")
def thread_depth(spark, d):
    c = t(spark, d, "conversations")
    e = c.where("turn > 0").select(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("p"), F.concat_ws(":", "conv_id", "turn").alias("c"))
    return graph.reach_levels(e, "p", "c").select("node", F.col("depth").cast("int").alias("depth"))


@query()
def actor_pagerank(spark, d):
    e = trade_weights(spark, d).select(F.col("a").alias("s"), (-(F.col("b") + 1)).alias("t"), F.col("weight").alias("w"))
    return graph.pagerank(e, "s", "t", "w", rounds=300, tolerance=1e-6).select("node", r9("rank").alias("rank"))


_BIRANK = "WITH e AS MATERIALIZED (SELECT o_custkey AS l, l_suppkey AS r, CAST(count(*) AS DOUBLE) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), x AS (SELECT 0 AS k, 'left' AS side, l AS node, 1.0e0 AS s FROM (SELECT DISTINCT l FROM e) UNION ALL SELECT 0, 'right', r, 1.0e0 FROM (SELECT DISTINCT r FROM e))"
_BIRANK = _BIRANK.replace("WITH e", "WITH RECURSIVE e") + """, i(k, side, node, s) AS (SELECT * FROM x UNION ALL SELECT k + 1, side, node, t / sum(t) OVER (PARTITION BY side) FROM (SELECT k, 'left' AS side, l AS node, sum(w * s) AS t FROM i JOIN e ON i.side = 'right' AND i.node = r WHERE k < 100 GROUP BY k, l
 UNION ALL SELECT k, 'right', r, sum(w * s) FROM i JOIN e ON i.side = 'left' AND i.node = l WHERE k < 100 GROUP BY k, r))"""


@query(f"{_BIRANK} SELECT side, node, round(s, 9) AS score FROM i WHERE k = 100")
def bipartite_birank(spark, d):
    e = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey", F.lit(1.0).alias("w"))
    return graph.birank(e, "o_custkey", "l_suppkey", "w", rounds=100).select("side", "node", r9("score").alias("score"))


@query()
def core_numbers(spark, d):
    return graph.core_numbers(co_edges(spark, d), "a", "b")


_NATION = "SELECT c_nationkey AS s, s_nationkey AS t, count(*) AS w FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL"


def nation_edges(spark, d):
    x = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return x.groupBy(F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("t")).agg(F.count(F.lit(1)).alias("w"))


def nation_members(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))


@query(f"""
WITH e AS ({_NATION}), j AS (SELECT e.*, a.n_regionkey AS cs, b.n_regionkey AS ct FROM e JOIN nation a ON a.n_nationkey = s JOIN nation b ON b.n_nationkey = t),
d AS (SELECT c, sum(w) * 1.0e0 AS dc FROM (SELECT cs AS c, w FROM j UNION ALL SELECT ct, w FROM j) GROUP BY c), l AS (SELECT cs AS c, sum(CASE WHEN cs = ct THEN w ELSE 0 END) * 1.0e0 AS lc FROM j GROUP BY cs), m AS (SELECT sum(w) * 1.0e0 AS m FROM e)
SELECT round(sum(coalesce(lc, 0) / m - (dc / (2 * m)) * (dc / (2 * m))), 9) AS modularity, count(*) AS communities FROM d LEFT JOIN l USING (c), m""")
def nation_modularity(spark, d):
    return graph.modularity(nation_edges(spark, d), "s", "t", "w", nation_members(spark, d)).select(r9("modularity").alias("modularity"), "communities")


@query(f"""
WITH e AS ({_NATION}), b AS (SELECT s AS node, t AS o, w FROM e UNION ALL SELECT t, s, w FROM e), i AS (SELECT node, n_regionkey AS c, sum(w) * 1.0e0 AS w FROM b JOIN nation ON n_nationkey = o GROUP BY ALL)
SELECT node, round(1 - sum(w * w) / (sum(w) * sum(w)), 9) AS participation, sum(w) AS strength FROM i GROUP BY node""")
def nation_participation(spark, d):
    return graph.participation(nation_edges(spark, d), "s", "t", "w", nation_members(spark, d)).select("node", r9("participation").alias("participation"), "strength")


@query("SELECT o_custkey, l_suppkey, count(*) AS weight, count(DISTINCT o_orderkey) AS containers FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def bipartite_weights(spark, d):
    return trade_weights(spark, d).withColumnRenamed("a", "o_custkey").withColumnRenamed("b", "l_suppkey")


# Labels, agreement, weighting

_RATED = "SELECT d.doc_id, d.lang, l.quality AS a, CASE WHEN d.n_chars >= 700 THEN 1 ELSE 0 END AS b FROM labels l JOIN documents d USING (doc_id)"


def rated(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").select("doc_id", "lang", F.col("quality").alias("a"), F.when(F.col("n_chars") >= 700, 1).otherwise(0).alias("b"))


@query(f"""
WITH x AS ({_RATED}), g AS (SELECT lang, count(*) AS n, avg(CASE WHEN a = b THEN 1.0e0 ELSE 0 END) AS po, avg(a * 1.0e0) AS pa, avg(b * 1.0e0) AS pb FROM x GROUP BY lang), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM g)
SELECT lang, n, round(po, 9) AS agreement, round(CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1.0e0 ELSE 0.0e0 END ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM e""")
def cohen_kappa(spark, d):
    return aggregates.cohen_kappa(rated(spark, d), ["lang"], "a", "b").select("lang", "n", r9("agreement").alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(f"""
WITH x AS ({_RATED}), c AS (SELECT v AS label, count(*) FILTER (WHERE a = v AND b = v) AS tp, count(*) FILTER (WHERE a <> v AND b = v) AS fp, count(*) FILTER (WHERE a = v AND b <> v) AS fn FROM x, (VALUES (0), (1)) w(v) GROUP BY v)
SELECT label, round(CASE WHEN tp + fp > 0 THEN tp * 1.0e0 / (tp + fp) ELSE 0 END, 9) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp * 1.0e0 / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0e0 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, tp + fn AS support FROM c""")
def class_metrics(spark, d):
    m = aggregates.class_metrics(rated(spark, d), "a", "b")
    return m.select("label", *[r9(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"SELECT a, b, count(*) AS n FROM ({_RATED}) GROUP BY a, b")
def confusion_matrix(spark, d):
    return rated(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH x AS (SELECT lang, a, (1 + {KEY_SQL.format("'p|' || CAST(doc_id AS VARCHAR)")} % 4) / 4.0e0 AS p FROM ({_RATED}))
SELECT lang, round(sum(a / p) / sum(1 / p), 9) AS prevalence, round(sum(1 / p) * sum(1 / p) / sum(1 / (p * p)), 6) AS effective_n, count(*) AS n FROM x GROUP BY lang""")
def hajek_prevalence(spark, d):
    x = rated(spark, d).withColumn("p", (1 + F.pmod(stats.stable_key(F.lit("p"), F.col("doc_id")), F.lit(4))) / 4.0)
    return aggregates.weighted_prevalence(x, ["lang"], F.col("a"), F.col("p")).select("lang", r9("prevalence").alias("prevalence"), F.round("effective_n", 6).alias("effective_n"), "n")


@query("""
WITH p(name, p) AS (VALUES ('H1', 0.01e0), ('H2', 0.04e0), ('H3', 0.03e0), ('H4', 0.2e0), ('H5', 0.005e0)), s AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM p)
SELECT name, p, round(max(least(1.0e0, (m - i + 1) * p)) OVER (ORDER BY p, name), 9) AS adjusted FROM s""")
def holm_adjust(spark, d):
    x = spark.createDataFrame([("H1", 0.01), ("H2", 0.04), ("H3", 0.03), ("H4", 0.2), ("H5", 0.005)], "name string, p double")
    return stats.holm(x).select("name", "p", r9("adjusted").alias("adjusted"))


@query("""
SELECT 0 AS step, 'long' AS gate, count(*) FILTER (WHERE n_chars >= 200) AS "left" FROM documents UNION ALL
SELECT 1, 'english', count(*) FILTER (WHERE n_chars >= 200 AND lang = 'en') FROM documents UNION ALL
SELECT 2, 'prose', count(*) FILTER (WHERE n_chars >= 200 AND lang = 'en' AND text NOT LIKE '%|%') FROM documents""")
def eligibility_flow(spark, d):
    return aggregates.eligibility_flow(t(spark, d, "documents"), {"long": F.col("n_chars") >= 200, "english": F.col("lang") == "en", "prose": ~F.contains("text", F.lit("|"))})


@query("""SELECT CASE WHEN NOT n_chars >= 200 THEN 'long' WHEN NOT lang = 'en' THEN 'english' WHEN text LIKE '%|%' THEN 'prose' ELSE 'eligible' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def exclusion_reasons(spark, d):
    gates = {"long": F.col("n_chars") >= 200, "english": F.col("lang") == "en", "prose": ~F.contains("text", F.lit("|"))}
    return t(spark, d, "documents").groupBy(aggregates.first_failure(gates).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(event_type, 'ALL') AS event_type, coalesce(band, 'ALL') AS band, count(*) AS n FROM (SELECT event_type, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS band FROM events) GROUP BY CUBE (event_type, band)""")
def crosstab_margins(spark, d):
    return aggregates.cramer_margins(t(spark, d, "events").select("event_type", F.when(F.col("value") >= 50, "high").otherwise("low").alias("band")), "event_type", "band")


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def pivot_counts(spark, d):
    p = t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("""SELECT c_nationkey, c_custkey, round(c_acctbal, 2) AS c_acctbal, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3""")
def topk_per_group(spark, d):
    return windows.top_k(t(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), "place")


@query("""
WITH c AS (SELECT n_name AS cell, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), x AS (SELECT cell, n, n * 100 / CAST(sum(n) OVER () AS DOUBLE) AS x FROM c),
f AS (SELECT *, floor(x) AS f FROM x), r AS (SELECT *, 100 - sum(f) OVER () AS rest, row_number() OVER (ORDER BY round(x - f, 9) DESC, cell) AS rn FROM f)
SELECT cell, n, CAST(f + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def quota_allocation(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return windows.largest_remainder(c, "n", 100, "cell")


@query(f"SELECT c_custkey, CAST({KEY_SQL.format("'split|' || CAST(c_nationkey AS VARCHAR)")} % 3 AS INTEGER) AS split FROM customer")
def split_assign(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.pmod(stats.stable_key(F.lit("split"), F.col("c_nationkey")), F.lit(3)).cast("int").alias("split"))


@query(f"""
WITH a AS (SELECT o_orderkey, o_custkey, o_orderpriority, {KEY_SQL.format("'cap|' || CAST(o_orderkey AS VARCHAR)")} AS k FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k, o_orderkey) AS rn, least(2, count(*) OVER (PARTITION BY o_custkey)) / CAST(count(*) OVER (PARTITION BY o_custkey) AS DOUBLE) AS p1 FROM a), c AS (SELECT * FROM b WHERE rn <= 2),
e AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY k, o_orderkey) AS rn2, least(100, count(*) OVER (PARTITION BY o_orderpriority)) / CAST(count(*) OVER (PARTITION BY o_orderpriority) AS DOUBLE) AS p2 FROM c)
SELECT o_orderkey, o_custkey, o_orderpriority, round(p1 * p2, 9) AS p FROM e WHERE rn2 <= 100""")
def two_stage_caps(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", stats.stable_key(F.lit("cap"), F.col("o_orderkey")).alias("k"))
    one = windows.capped(x, ["o_custkey"], F.col("k"), "o_orderkey", 2, "p1")
    two = windows.capped(one, ["o_orderpriority"], F.col("k"), "o_orderkey", 100, "p2")
    return two.select("o_orderkey", "o_custkey", "o_orderpriority", r9(F.col("p1") * F.col("p2")).alias("p"))


@query("""
WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0e0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0e0 AS b FROM part)
SELECT p_brand, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY p_brand""")
def spearman_rho(spark, d):
    return windows.spearman(t(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", F.round("rho", 6).alias("rho"), "n")


@query("""SELECT n.n_regionkey AS left_out, round(avg(c_acctbal), 6) AS mean, count(*) AS n FROM (SELECT DISTINCT n_regionkey FROM nation) n, customer c JOIN nation m ON m.n_nationkey = c.c_nationkey WHERE m.n_regionkey <> n.n_regionkey GROUP BY 1""")
def leave_one_out(spark, d):
    nation = t(spark, d, "nation")
    x = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.sum("c_acctbal").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return x.select(F.col("n_regionkey").alias("left_out"), F.round((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n")), 6).alias("mean"), (F.sum("n").over(w) - F.col("n")).alias("n"))


_TYPES = ["click", "error", "purchase", "signup", "view"]
_PROFILE = "SELECT user_id, user_id % 7 AS community, count(*) AS activity, " + ", ".join(f"avg(CASE WHEN event_type = '{k}' THEN 1.0e0 ELSE 0 END) AS {k}" for k in _TYPES) + " FROM events GROUP BY user_id HAVING count(*) >= 3"


def user_profiles(spark, d):
    shares = [F.avg((F.col("event_type") == k).cast("double")).alias(k) for k in _TYPES]
    return t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("activity"), *shares).where("activity >= 3").withColumn("community", F.col("user_id") % 7)


_COMM = ", ".join(f"sum({k} * activity) / sum(activity) AS {k}" for k in _TYPES)
_JSD = "(" + " + ".join(f"CASE WHEN c.{k} > 0 THEN c.{k} * log2(2 * c.{k} / (c.{k} + w.{k})) ELSE 0 END + CASE WHEN w.{k} > 0 THEN w.{k} * log2(2 * w.{k} / (c.{k} + w.{k})) ELSE 0 END" for k in _TYPES) + ") / 2"


@query(f"WITH p AS ({_PROFILE}), c AS (SELECT community, sum(activity) AS a, {_COMM} FROM p GROUP BY community), w AS (SELECT {_COMM} FROM p) SELECT round(sum(a * {_JSD}) / sum(a), 9) AS segregation, count(*) AS communities FROM c, w")
def segregation_jsd(spark, d):
    return aggregates.segregation(user_profiles(spark, d), "community", "activity", _TYPES).select(r9("segregation").alias("segregation"), "communities")


@query(f"WITH p AS ({_PROFILE}) SELECT user_id, round(-({' + '.join(f'CASE WHEN {k} > 0 THEN {k} * ln({k}) ELSE 0 END' for k in _TYPES)}) / ln(5.0e0), 9) AS entropy, activity FROM p")
def author_profiles(spark, d):
    return user_profiles(spark, d).select("user_id", r9(stats.entropy_normalised(F.array(*_TYPES), 5)).alias("entropy"), "activity")


@query("""
WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT user_id, sum(n) AS total, sum(CASE WHEN n > 12 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS ratio FROM g GROUP BY 1), a AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1)
SELECT user_id, CASE WHEN total >= 20 AND ratio >= 0.5 THEN 'repeater' WHEN total / CAST(days AS DOUBLE) >= 2.5 AND total >= 50 THEN 'high_volume' ELSE 'ordinary' END AS class FROM u JOIN a USING (user_id)""")
def account_class(spark, d):
    e = day_events(spark, d)
    u = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.sum("n").alias("total"), (F.sum(F.when(F.col("n") > 12, F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"))
    a = e.groupBy("user_id").agg(F.countDistinct("day").alias("days"))
    c = F.when((F.col("total") >= 20) & (F.col("ratio") >= 0.5), "repeater").when((F.col("total") / F.col("days") >= 2.5) & (F.col("total") >= 50), "high_volume").otherwise("ordinary")
    return u.join(a, "user_id").select("user_id", c.alias("class"))


# Coverage, seen sets, upserts, sets, guards

@query("""SELECT side, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) GROUP BY side""")
def label_coverage(spark, d):
    return joins.coverage(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_seen(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_corpus(spark, d):
    return t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def upsert_latest(spark, d):
    return windows.latest(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_operations(spark, d):
    a, b = t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return one("union", a.union(b).distinct()).unionByName(one("intersect", a.intersect(b))).unionByName(one("except", a.distinct().exceptAll(b.distinct())))


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def guarded_join(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.many_to_one(t(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_mktsegment")


@query(f"""
WITH x AS (SELECT c_custkey, c_nationkey, c_mktsegment = 'BUILDING' AS role, {KEY_SQL.format("'m|' || CAST(c_custkey AS VARCHAR)")} AS k FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, role ORDER BY k, c_custkey) AS rn FROM x)
SELECT a.c_nationkey, CAST(a.rn AS INTEGER) AS "set", a.c_custkey AS treated, b.c_custkey AS control FROM r a JOIN r b ON a.c_nationkey = b.c_nationkey AND a.role AND NOT b.role AND a.rn = ceil(b.rn / 3.0e0)""")
def matched_controls(spark, d):
    return joins.matched_bins(t(spark, d, "customer"), "c_custkey", F.col("c_mktsegment") == "BUILDING", ["c_nationkey"], order=stats.stable_key(F.lit("m"), F.col("c_custkey"))).select("c_nationkey", "set", "treated", "control")


@query("""SELECT p_brand, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1) * 4 / CAST(count(*) OVER (PARTITION BY p_brand) AS DOUBLE)) AS INTEGER) AS bin, p_partkey FROM part""")
def quartile_bins(spark, d):
    return windows.quartile_bins(t(spark, d, "part"), ["p_brand"], ["p_retailprice", "p_partkey"]).select("p_brand", "bin", "p_partkey")


@query("""WITH s AS (SELECT lang, sum(quality) AS h, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang), p AS (SELECT lang, n, h / CAST(n AS DOUBLE) AS p, 1.959963984540054e0 AS z FROM s)
SELECT lang, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0e0 * n * n))) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0e0 * n * n))) / (1 + z * z / n), 9) AS high FROM p""")
def wilson_interval(spark, d):
    s = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("h"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("h"), F.col("n"))
    return s.select("lang", "n", r9(low).alias("low"), r9(high).alias("high"))


@query("""SELECT p_brand, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, count(*) AS n FROM part GROUP BY p_brand""")
def ols_slope(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.round(F.regr_slope("p_retailprice", F.col("p_size").cast("double")), 6).alias("slope"), F.round(F.regr_intercept("p_retailprice", F.col("p_size").cast("double")), 4).alias("intercept"), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_nationkey, c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) AS z, round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) AS scaled FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def standardised(spark, d):
    w = Window.partitionBy("c_nationkey")
    b = F.col("c_acctbal")
    return t(spark, d, "customer").select("c_nationkey", "c_custkey", F.round((b - F.avg(b).over(w)) / F.stddev_pop(b).over(w), 6).alias("z"), F.round((b - F.min(b).over(w)) / (F.max(b).over(w) - F.min(b).over(w)), 6).alias("scaled"))


@query("""
WITH m AS (SELECT user_id, date_trunc('week', ts) AS wk, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, CAST(wk AS DATE) AS wk, arg_max(event_type, n * 10 - CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END) AS c FROM m GROUP BY 1, 2),
s AS (SELECT wk, c, count(*) AS n FROM p GROUP BY ALL), o AS (SELECT a.wk, a.c AS before, b.c AS after, count(*) AS k FROM p a JOIN p b ON a.user_id = b.user_id AND b.wk = a.wk + 7 GROUP BY ALL)
SELECT o.wk, before, after, round(k / CAST(x.n + y.n - k AS DOUBLE), 9) AS jaccard FROM o JOIN s x ON x.wk = o.wk AND x.c = before JOIN s y ON y.wk = o.wk + 7 AND y.c = after WHERE k / CAST(x.n + y.n - k AS DOUBLE) >= 0.2e0""", dates=("wk",))
def partition_lifecycle(spark, d):
    m = t(spark, d, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("wk"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = m.groupBy("user_id", "wk").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("c"))
    s = p.groupBy("wk", "c").agg(F.count(F.lit(1)).alias("n"))
    later = p.select("user_id", F.date_sub("wk", 7).alias("wk"), F.col("c").alias("after"))
    o = p.join(later, ["user_id", "wk"]).groupBy("wk", F.col("c").alias("before"), "after").agg(F.count(F.lit(1)).alias("k"))
    j = o.join(s.select("wk", F.col("c").alias("before"), F.col("n").alias("nx")), ["wk", "before"]).join(s.select(F.date_sub("wk", 7).alias("wk"), F.col("c").alias("after"), F.col("n").alias("ny")), ["wk", "after"])
    jac = F.col("k") / (F.col("nx") + F.col("ny") - F.col("k"))
    return j.where(jac >= 0.2).select("wk", "before", "after", r9(jac).alias("jaccard"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT event_id, CAST(ts AS DATE) AS day, printf('%d-W%02d', CAST(isoyear(ts) AS INTEGER), CAST(weekofyear(ts) AS INTEGER)) AS iso_week, strftime(ts, '%Y-%m') AS month, CAST(isodow(ts) AS INTEGER) AS dow FROM events""", dates=("day",))
def date_parts(spark, d):
    ts = F.col("ts")
    return t(spark, d, "events").select("event_id", F.to_date(ts).alias("day"), F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts)).alias("iso_week"), F.date_format(ts, "yyyy-MM").alias("month"), (F.weekday(ts) + 1).alias("dow"))


# Sources, collection state, streams

@query("""SELECT scope, event_type, segment FROM (VALUES ('w1'), ('w2'), ('w3')) a(scope), (VALUES ('click'), ('view')) b(event_type), (VALUES ('BUILDING'), ('MACHINERY')) c(segment)""")
def task_grid(spark, d):
    return files.task_grid(spark, {"scope": [w[0] for w in WINDOWS], "event_type": ["click", "view"], "segment": ["BUILDING", "MACHINERY"]})


@query("""SELECT user_id, string_agg(event_type, '|' ORDER BY event_type) AS routes FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def merged_routes(spark, d):
    return files.merged_routes(t(spark, d, "events"), "user_id", "event_type").select("user_id", F.array_join("routes", "|").alias("routes"))


@query("""SELECT o_orderpriority, count(*) AS tasks, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'F') = count(*) AS finished FROM orders GROUP BY o_orderpriority""")
def completion_rollup(spark, d):
    return files.completion(t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "P")


@query("""SELECT user_id, arg_min(event_type, ROW(ts, event_id)) AS first_handle, count(*) AS rows, bool_or(event_type = 'purchase') AS strong FROM events GROUP BY user_id""")
def discovered_authors(spark, d):
    return files.discovered(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("event_type") == "purchase")


@query("""SELECT user_id, min(event_id) AS event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.value > 90 AND p.user_id = e.user_id) GROUP BY user_id""")
def unseen_keys(spark, d):
    e = t(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return files.unseen(first, e.where("event_type = 'purchase' and value > 90"), "user_id")


@query("""SELECT conv_id, max(turn) AS replies FROM conversations GROUP BY conv_id HAVING max(turn) >= 5""")
def thread_candidates(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("replies")).where("replies >= 5")


@query(f"""SELECT day, count(*) AS n, count(*) >= 340 AS saturated FROM ({EVENTS_DAY}) GROUP BY day""", dates=("day",))
def saturated_days(spark, d):
    return day_events(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("saturated", F.col("n") >= 340)


@query(f"""SELECT event_id, name AS anchor, coalesce(day - w > 14, false) AS is_late, coalesce(day - w < 0, false) AS is_early FROM ({EVENTS_DAY}), (VALUES ('E1', DATE '2024-01-05'), ('E2', DATE '2024-01-15'), ('E3', DATE '2024-01-25')) c(name, w)""")
def flagged_late(spark, d):
    cal = spark.createDataFrame(CALENDAR, "anchor string, w string").select("anchor", F.to_date("w").alias("w"))
    paired = day_events(spark, d).crossJoin(F.broadcast(cal))  # three rows
    return streams.flag_late(paired, F.col("day"), F.col("w"), 14).select("event_id", "anchor", "is_late", "is_early")


def _drained(spark: SparkSession, shape: DataFrame, mode: str) -> DataFrame:
    at = f"{shared_folder(spark)}/threadloom/stream-{uuid.uuid4().hex}"
    return streams.drain(shape, at + "/out", at + "/state", mode)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.table_stream(spark, d, "events", t(spark, d, "events").schema)


@query(f"""SELECT day, event_type, count(*) AS n FROM ({EVENTS_DAY}) GROUP BY ALL""", dates=("day",))
def stream_day_counts(spark, d):
    return _drained(spark, streams.day_counts(_event_stream(spark, d), "ts", ["event_type"]), "complete")


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_first_seen(spark, d):
    return _drained(spark, streams.first_seen(_event_stream(spark, d).select("user_id", "event_type"), ["user_id", "event_type"]), "append")


@query(f"""SELECT CAST(day - CAST(i AS INTEGER) AS DATE) AS start, event_type, count(*) AS n FROM ({EVENTS_DAY}), range(7) r(i) GROUP BY ALL""", dates=("start",))
def stream_sliding_weeks(spark, d):
    return _drained(spark, streams.sliding_counts(_event_stream(spark, d), "ts", ["event_type"]), "complete")


@query(f"""SELECT event_id, w.scope FROM events, {WINDOWS_SQL} WHERE ts >= s AND ts < e""")
def stream_event_windows(spark, d):
    """Streamed events with the windows that hold them; the windows are a static table."""
    dim = spark.createDataFrame(WINDOWS, "scope string, s string, e string").select("scope", F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))
    return _drained(spark, joins.in_window(_event_stream(spark, d), F.col("ts"), dim).select("event_id", "scope"), "append")
