"""Queries on texts, identifiers and populations, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import prepare
from threadloom.operators import populations
from threadloom.registry import WINDOWS, day_events, query, r9, t

# Texts

_LETTERS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '')"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_HITS = ", ".join(f"len(list_filter(k, lambda w: w IN {_IN(own)}))::INTEGER AS {lang}" for lang, own in prepare.FUNCTION_WORDS.items())
_BEST = "CASE WHEN en + de + fr + es = 0 THEN NULL WHEN en >= de AND en >= fr AND en >= es THEN 'en' WHEN de >= fr AND de >= es THEN 'de' WHEN fr >= es THEN 'fr' ELSE 'es' END"
_DETECTED = f"""SELECT doc_id, lang, source, chars, {_BEST} AS detected, CASE WHEN en + de + fr + es > 0 THEN greatest(en, de, fr, es) / CAST(en + de + fr + es AS DOUBLE) END AS confidence
FROM (SELECT doc_id, lang, source, length(text) AS chars, {_HITS} FROM (SELECT *, {_LETTERS} AS k FROM documents))"""
_UNSURE = f"(confidence IS NULL OR confidence < {prepare.LEAST_CONFIDENCE} OR chars < {prepare.LEAST_CHARS})"


def languages(spark, d):
    x = t(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").alias("chars"), prepare.language_hits(prepare.letters(F.col("text"))).alias("hits"))
    found, share = prepare.detected(F.col("hits"))
    return x.withColumns({"detected": found, "confidence": share}).drop("hits")


@query(f"SELECT doc_id, detected, round(confidence, 9) AS confidence, {_UNSURE} AS uncertain FROM ({_DETECTED})")
def language_detection(spark, d):
    return languages(spark, d).select("doc_id", "detected", r9("confidence").alias("confidence"), prepare.uncertain(F.col("confidence"), F.col("chars")).alias("uncertain"))


_SURE = f"(confidence >= {prepare.OVERRULE_CONFIDENCE} AND chars >= {prepare.OVERRULE_CHARS})"


@query(f"""SELECT doc_id, CASE WHEN chars = 0 THEN 'no_text' WHEN lang = 'en' AND detected = 'en' THEN 'declared_confirmed' WHEN lang = 'en' AND detected IS NOT NULL AND {_SURE} THEN 'declared_overridden' WHEN lang = 'en' THEN 'declared'
 WHEN lang <> '' AND detected = 'en' AND {_SURE} THEN 'detected_override' WHEN lang <> '' THEN 'declared_other' WHEN detected = 'en' THEN 'detected' WHEN detected IS NOT NULL THEN 'detected_other' ELSE 'undetectable' END AS basis FROM ({_DETECTED})""")
def language_resolution(spark, d):
    return languages(spark, d).select("doc_id", prepare.language_basis(F.col("lang"), F.col("detected"), F.col("confidence"), F.col("chars")).alias("basis"))


@query(f"""SELECT lang, count(*) AS "rows", count(*) FILTER (WHERE detected = 'en' AND NOT {_UNSURE}) AS strict, count(*) FILTER (WHERE detected = 'en' OR {_UNSURE}) AS inclusive, count(*) FILTER (WHERE {_UNSURE}) AS uncertain,
 count(DISTINCT CASE WHEN detected = 'en' AND NOT {_UNSURE} THEN source END) AS authors, count(DISTINCT CASE WHEN detected = 'en' AND NOT {_UNSURE} THEN doc_id END) AS containers FROM ({_DETECTED}) GROUP BY lang""")
def coverage_row(spark, d):
    x, unsure = languages(spark, d), prepare.uncertain(F.col("confidence"), F.col("chars"))
    english = F.coalesce(F.col("detected") == "en", F.lit(False))
    return populations.coverage_row(x, ["lang"], english & ~unsure, english | unsure, unsure, "source", "doc_id")


_TOKENS = f"list_filter({_LETTERS}, lambda w: (length(w) >= 3 OR w IN {_IN(prepare.KEEPWORDS)}) AND w NOT IN {_IN(prepare.STOPWORDS)})"


@query(f"SELECT doc_id, len(k)::INTEGER AS n, md5(array_to_string(k, ' ')) AS tokens_md5, len(k) < 3 AS low_information FROM (SELECT doc_id, {_TOKENS} AS k FROM documents)")
def topic_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", prepare.topic_tokens(F.col("text")).alias("k")).select("doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ")).alias("tokens_md5"), (F.size("k") < 3).alias("low_information"))


_VIEW = "text"
for _short, _full in prepare.CONTRACTIONS.items():
    _VIEW = f"replace({_VIEW}, '{_short.replace(chr(39), chr(39) * 2)}', '{_full}')"


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace({_VIEW}, '(?:https?://|www\.)[^ \t\n\r<>]+', '<URL>', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS view_md5 FROM documents")
def sentiment_view(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(prepare.sentiment_view(F.col("text"))).alias("view_md5"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{prepare.EMOJI}'))::INTEGER AS emojis, md5(regexp_replace(text, '[​‌‍⁠﻿]', '', 'g')) AS bare_md5 FROM documents")
def emoji_and_zero_width(spark, d):
    return t(spark, d, "documents").select("doc_id", prepare.emoji_count(F.col("text")).alias("emojis"), F.md5(prepare.without_zero_width(F.col("text"))).alias("bare_md5"))


PROMO = ["license", "licensed", "version", "free", "token", "password"]
_FOLDED = "(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ')"


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN contains({_FOLDED}, {chr(39)} {p} {chr(39)}) THEN {chr(39)}{p}{chr(39)} END' for p in PROMO)}], lambda x: x IS NOT NULL), '|') AS hits FROM documents")
def promo_hits(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(prepare.guarded_hits(F.col("text"), PROMO), "|").alias("hits"))


#: A small lexicon in place of the full one, which is a parameter.
LEXICON = {"free": 1.5, "secret": -1.0, "password": -0.5, "under": -0.2, "with": 0.3, "licensed": 0.8, "and": 0.1, "nicht": -1.2, "not": -1.4, "les": 0.2}
_VALENCE = " + ".join(f"{v!r}e0 * len(list_filter(k, lambda w: w = '{w}'))" for w, v in LEXICON.items())


@query(f"SELECT doc_id, round(s / sqrt(s * s + 15), 6) AS compound, CASE WHEN s / sqrt(s * s + 15) >= 0.05 THEN 'positive' WHEN s / sqrt(s * s + 15) <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT doc_id, round({_VALENCE}, 6) AS s FROM (SELECT doc_id, {_LETTERS} AS k FROM documents))")
def sentiment_scores(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.round(prepare.valence(prepare.letters(F.col("text")), LEXICON), 6).alias("s"))
    c = prepare.compound(F.col("s"))
    return x.select("doc_id", F.round(c, 6).alias("compound"), prepare.sentiment_label(c).alias("label"))


CHANNELS = [("education", ["ed", "th"]), ("news", ["an", "on"]), ("shop", ["er"])]


@query(r"""SELECT page_id, host, CASE WHEN contains(host, 'ed') OR contains(host, 'th') THEN 'education' WHEN contains(host, 'an') OR contains(host, 'on') THEN 'news' WHEN contains(host, 'er') THEN 'shop' ELSE 'other' END AS kind
FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^(www|m)\.', '') AS host FROM pages)""")
def channel_types(spark, d):
    return t(spark, d, "pages").select("page_id", prepare.url_host(F.col("url")).alias("host")).withColumn("kind", prepare.channel_type(F.col("host"), CHANNELS))


@query("""SELECT user_id, substr(sha256('salt|events|' || user_id), 1, 16) AS author_hash, 'user_' || user_id AS typed, count(*) AS n FROM events GROUP BY user_id""")
def pseudonyms(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", prepare.author_hash("salt", "events", F.col("user_id")).alias("author_hash"), prepare.typed_id("user", F.col("user_id")).alias("typed"), "n")


@query()
def shared_masking(spark, d):
    """Lookarounds are beyond the SQL engine's patterns; the tests hold it against a plain implementation."""
    return t(spark, d, "documents").select("doc_id", F.md5(prepare.shared_mask(F.col("text"))).alias("masked_md5"))


FRAMES = {"identity": r"(?ix) \b (document|licen[cs]e[sd]?) \b", "control": r"(?ix) \b (password|secret|token) s? \b", "contact": r"(?ix) [\w.]+ @ [\w.]+"}


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(document|licen[cs]e[sd]?)\b') AS identity, regexp_matches(text, '(?i)\b(password|secret|token)s?\b') AS control, regexp_matches(text, '(?i)[\w.]+@[\w.]+') AS contact FROM documents""")
def verbose_frames(spark, d):
    return t(spark, d, "documents").select("doc_id", *[F.col("text").rlike(p).alias(name) for name, p in FRAMES.items()])


# Dates

@query("""SELECT l_orderkey, l_linenumber, CAST(abs(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) > 1 AS BOOLEAN) AS drift, l_shipdate < o_orderdate AS backdated, CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400) AS BIGINT) AS age_days
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def index_drift(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    gap = F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return x.select("l_orderkey", "l_linenumber", (F.abs(F.datediff("l_shipdate", "o_orderdate")) > 1).alias("drift"), (F.col("l_shipdate") < F.col("o_orderdate")).alias("backdated"), F.floor(gap / 86_400_000_000).alias("age_days"))


def windows_dim(spark, rows):
    return spark.createDataFrame(rows, "scope string, s string, e string").select("scope", F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))


#: Windows of seven days before and 21 after an event; they overlap.
AROUND = [("E1", "2023-12-29", "2024-01-26"), ("E2", "2024-01-08", "2024-02-05")]


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2023-12-29' AND ts < TIMESTAMP '2024-01-26' THEN 'E1' WHEN ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-02-05' THEN 'E2' ELSE 'none' END AS scope FROM events")
def event_window_first(spark, d):
    return populations.first_window(t(spark, d, "events"), F.col("ts"), windows_dim(spark, AROUND), "event_id").select("event_id", "scope")


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'w1' WHEN ts < TIMESTAMP '2024-01-21' THEN 'w2' WHEN ts < TIMESTAMP '2024-01-31' THEN 'w3' ELSE 'none' END AS scope FROM events")
def case_windows(spark, d):
    return populations.case_window(t(spark, d, "events"), F.col("ts"), windows_dim(spark, WINDOWS)).select("event_id", "scope")


@query("SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_bound, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_bound, event_type FROM events GROUP BY event_type")
def utc_bounds(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(prepare.utc_bound(F.min("ts")).alias("first_bound"), prepare.utc_bound(F.max("ts")).alias("last_bound"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, " + ", ".join(f"CAST(isodow(CAST(ts AS DATE)) = {k} AS INTEGER) AS dow{k}" for k in range(2, 8)) + " FROM events GROUP BY CAST(ts AS DATE)")
def day_of_week_dummies(spark, d):
    iso = F.weekday("day") + 1
    return day_events(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")).select(F.col("day").cast("string").alias("day"), "n", *[(iso == k).cast("int").alias(f"dow{k}") for k in range(2, 8)])


@query("""SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') AS inside, count(*) FILTER (WHERE NOT (ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20')) AS outside, count(*) FILTER (WHERE ts IS NULL) AS invalid FROM events""")
def window_flow(spark, d):
    return populations.window_flow(t(spark, d, "events"), F.col("ts"), "2024-01-05", "2024-01-20")


# Populations and audits

@query("""WITH x AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT * FROM (SELECT 'all' AS population, count(*) AS n FROM x UNION ALL SELECT 'english', count(*) FILTER (WHERE lang = 'en') FROM x UNION ALL SELECT 'labelled', count(*) FILTER (WHERE quality IS NOT NULL) FROM x
UNION ALL SELECT 'clean', count(*) FILTER (WHERE quality = 1 AND toxic = 0) FROM x UNION ALL SELECT 'sentiment', count(*) FILTER (WHERE lang = 'en' AND n_chars >= 100) FROM x UNION ALL SELECT 'review', count(*) FILTER (WHERE quality = 1 AND toxic = 1 OR n_chars < 3) FROM x)""")
def population_registry(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    masks = {"all": F.lit(True), "english": F.col("lang") == "en", "labelled": F.col("quality").isNotNull(), "clean": good & (F.col("toxic") == 0), "sentiment": (F.col("lang") == "en") & (F.col("n_chars") >= 100), "review": (good & bad) | (F.col("n_chars") < 3)}
    return populations.population_counts(x, masks)


STRATA = {"short": "n_chars < 80", "long": "n_chars >= 20000", "other_language": "lang <> 'en'", "quoting": "text LIKE '%>%'", "numbers": "regexp_matches(text, '[0-9]')", "lines": "contains(text, chr(10))", "general": "n_chars >= 80 AND lang = 'en'"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS population, count(*) FILTER (WHERE {v}) AS n FROM documents" for k, v in STRATA.items()))
def sampling_masks(spark, d):
    c, x = F.col("n_chars"), F.col("text")
    masks = {"short": c < 80, "long": c >= 20000, "other_language": F.col("lang") != "en", "quoting": F.contains(x, F.lit(">")), "numbers": x.rlike("[0-9]"), "lines": F.contains(x, F.lit("\n")), "general": (c >= 80) & (F.col("lang") == "en")}
    return populations.population_counts(t(spark, d, "documents"), masks)


def robust_filters():
    return {"no_short": (["n_chars"], F.col("n_chars") >= 200), "english_only": (["lang"], F.col("lang") == "en"), "known_source": (["source"], F.col("source").isNotNull())}


@query("SELECT 'no_short' AS filter, count(*) FILTER (WHERE n_chars >= 200) AS n FROM documents UNION ALL SELECT 'english_only', count(*) FILTER (WHERE lang = 'en') FROM documents UNION ALL SELECT 'known_source', count(*) FILTER (WHERE source IS NOT NULL) FROM documents")
def robustness_filters(spark, d):
    filters, x = robust_filters(), t(spark, d, "documents")
    parts = [populations.robustness_filter(x, name, filters).agg(F.lit(name).alias("filter"), F.count(F.lit(1)).alias("n")) for name in filters]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT 'quality_domain' AS rule, count(*) FILTER (WHERE quality IS NULL OR quality NOT IN (0, 1)) AS violations FROM labels UNION ALL SELECT 'toxic_domain', count(*) FILTER (WHERE toxic IS NULL OR toxic NOT IN (0, 1)) FROM labels
UNION ALL SELECT 'clean_if_good', count(*) FILTER (WHERE NOT coalesce(quality = 0 OR toxic = 0, false)) FROM labels UNION ALL SELECT 'id', count(*) FILTER (WHERE doc_id IS NULL) FROM labels""")
def label_audit(spark, d):
    q, x = F.col("quality"), F.col("toxic")
    return populations.violations(t(spark, d, "labels"), {"quality_domain": q.isin(0, 1), "toxic_domain": x.isin(0, 1), "clean_if_good": (q == 0) | (x == 0), "id": F.col("doc_id").isNotNull()})


@query("""SELECT 'text' AS rule, count(*) FILTER (WHERE text IS NULL OR text = '') AS violations FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars <> length(text)) FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang NOT IN ('en', 'de')) FROM documents
UNION ALL SELECT 'source', count(*) FILTER (WHERE NOT regexp_matches(source, '^src[0-9]$')) FROM documents""")
def schema_report(spark, d):
    rules = {"text": F.length("text") > 0, "n_chars": F.col("n_chars") == F.length("text"), "lang": F.col("lang").isin("en", "de"), "source": F.col("source").rlike("^src[0-9]$")}
    return populations.violations(t(spark, d, "documents"), rules)


_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(rf"""WITH x AS (SELECT doc_id, source, sha256(n) AS h, length(n) AS c FROM (SELECT *, {_NORM} AS n FROM documents)), a AS (SELECT h, count(DISTINCT source) AS k FROM x WHERE c >= 20 GROUP BY h)
SELECT doc_id, coalesce(k, 0) AS copy_authors, row_number() OVER (PARTITION BY source, x.h ORDER BY doc_id) > 1 AND c >= 30 AS repeats_own FROM x LEFT JOIN a ON a.h = x.h""")
def copy_paste_counts(spark, d):
    norm = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return populations.copy_paste(t(spark, d, "documents").select("doc_id", "source", "text"), "source", norm, ["doc_id"]).select("doc_id", "copy_authors", "repeats_own")


@query(r"""WITH x AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, len(regexp_extract_all(html, 'https?://'))::INTEGER AS urls, len(regexp_extract_all(html, '[A-Za-z]+'))::INTEGER AS tokens, contains(lower(html), 'free') AS promo FROM pages)
SELECT page_id, count(*) OVER (PARTITION BY host) AS author_rows, urls >= 2 OR (urls >= 1 AND tokens <= 4) AS link_heavy, regexp_matches(lower(host), '(^|[_-])bot($|[_-])|automod|moderator') AS bot,
array_to_string(list_filter([CASE WHEN promo AND urls >= 1 THEN 'promo_link' END, CASE WHEN urls >= 3 THEN 'many_urls' END, CASE WHEN regexp_matches(lower(host), '(^|[_-])bot($|[_-])|automod|moderator') AND (urls >= 2 OR (urls >= 1 AND tokens <= 4)) THEN 'bot_link_pattern' END], lambda r: r IS NOT NULL), '|') AS spam_reasons FROM x""")
def corpus_flags(spark, d):
    x = t(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_count("html", F.lit("https?://")).alias("urls"), F.regexp_count("html", F.lit("[A-Za-z]+")).alias("tokens"), F.contains(F.lower("html"), F.lit("free")).alias("promo"))
    return populations.corpus_flags(x, "host", F.col("urls"), F.col("tokens"), F.col("promo"), F.col("host")).select("page_id", "author_rows", "link_heavy", "bot", "spam_reasons")


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS part FROM events GROUP BY ALL)
SELECT day, n, part, part * 1.0e0 / n >= 0.2 AND n * 1.0e0 / (SELECT median(n) FROM s) >= 1.02 AS wave FROM s""", dates=("day",))
def wave_days(spark, d):
    return populations.wave_days(day_events(spark, d), "day", F.col("event_type") == "view", volume=1.02)


@query("""WITH g AS (SELECT user_id, event_type, CAST(floor(value) AS INTEGER) AS v, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT user_id, sum(n) AS total, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS repeats FROM g GROUP BY 1),
a AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days, avg(CASE WHEN event_type = 'error' THEN 1.0e0 ELSE 0 END) > 0.3 AS bot FROM events GROUP BY 1)
SELECT user_id, round(repeats * 1.0e0 / total, 9) AS repeat_ratio, round(total * 1.0e0 / days, 9) AS rate, CASE WHEN user_id % 97 = 0 THEN 'labelled_spam' WHEN bot THEN 'labelled_bot' WHEN user_id % 89 = 0 THEN 'bridged' WHEN total >= 20 AND repeats * 1.0e0 / total >= 0.5 THEN 'repeater' WHEN total * 1.0e0 / days >= 10 AND total >= 50 THEN 'high_volume' ELSE 'ordinary' END AS class
FROM u JOIN a USING (user_id)""")
def account_classes(spark, d):
    e = day_events(spark, d)
    u = e.groupBy("user_id", "event_type", F.floor("value").cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeats"))
    a = e.groupBy("user_id").agg(F.countDistinct("day").alias("days"), (F.avg((F.col("event_type") == "error").cast("double")) > 0.3).alias("labelled_bot"))
    x = u.join(a, "user_id").withColumns({"labelled_spam": F.col("user_id") % 97 == 0, "bridged": F.col("user_id") % 89 == 0})
    return populations.account_classes(x).select("user_id", r9("repeat_ratio").alias("repeat_ratio"), r9("rate").alias("rate"), "class")


@query("""SELECT lang, label, share FROM (SELECT lang, avg(CASE WHEN quality = 1 THEN 1.0e0 ELSE 0 END) AS good, avg(CASE WHEN toxic = 1 THEN 1.0e0 ELSE 0 END) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang) UNPIVOT (share FOR label IN (good, toxic))""")
def label_shares(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    own = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    return populations.label_shares(x, ["lang"], own, ["good", "toxic"])


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS hits FROM events GROUP BY ALL)
SELECT round(1000.0e0 * sum(hits) FILTER (WHERE day < DATE '2024-01-15') / sum(n) FILTER (WHERE day < DATE '2024-01-15'), 6) AS pre_per_1k, round(1000.0e0 * sum(hits) FILTER (WHERE day >= DATE '2024-01-15') / sum(n) FILTER (WHERE day >= DATE '2024-01-15'), 6) AS post_per_1k FROM s""")
def frame_rates(spark, d):
    before = F.col("day") < F.lit("2024-01-15").cast("date")
    rate = lambda side: F.round(1000.0 * F.sum(F.when(side, F.col("hits"))) / F.sum(F.when(side, F.col("n"))), 6)
    s = day_events(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("hits"))
    return s.agg(rate(before).alias("pre_per_1k"), rate(~before).alias("post_per_1k"))


@query("""SELECT 'coverage' AS gate, avg(CASE WHEN n_chars > 0 THEN 1.0e0 ELSE 0 END) AS value, avg(CASE WHEN n_chars > 0 THEN 1.0e0 ELSE 0 END) >= 0.99 AS passed FROM documents UNION ALL SELECT 'unique_ids', count(DISTINCT doc_id) / CAST(count(*) AS DOUBLE), count(DISTINCT doc_id) / CAST(count(*) AS DOUBLE) >= 1.0 FROM documents
UNION ALL SELECT 'unique_texts', count(DISTINCT text) / CAST(count(*) AS DOUBLE), count(DISTINCT text) / CAST(count(*) AS DOUBLE) >= 0.99 FROM documents""")
def quality_gates(spark, d):
    share = lambda c: F.count_distinct(c) / F.count(F.lit(1))
    gates = {"coverage": (F.avg((F.col("n_chars") > 0).cast("double")), 0.99), "unique_ids": (share(F.col("doc_id")), 1.0), "unique_texts": (share(F.xxhash64("text")), 0.99)}
    return populations.quality_gates(t(spark, d, "documents"), gates)


@query("""WITH s AS (SELECT conv_id, count(*) AS n, max(turn) AS last, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n >= 8 THEN 'capped' WHEN blank = n THEN 'unavailable' WHEN n = 1 THEN 'genuine_zero' ELSE 'complete' END AS status FROM s""")
def seed_status(spark, d):
    s = t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"))
    return s.select("conv_id", F.when(F.col("n") >= 8, "capped").when(F.col("blank") == F.col("n"), "unavailable").when(F.col("n") == 1, "genuine_zero").otherwise("complete").alias("status"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(k > 2 AS INTEGER), p_retailprice DESC, p_partkey) AS r FROM k)
SELECT p_brand, p_type, p_partkey FROM r WHERE r <= 12""")
def quota_top(spark, d):
    return populations.quota_top(t(spark, d, "part"), ["p_brand"], "p_type", [F.desc("p_retailprice"), F.col("p_partkey")], 2, 12).select("p_brand", "p_type", "p_partkey")


@query("""WITH m AS (SELECT DISTINCT CAST(floor(date_part('day', ts) / 8) AS BIGINT) AS period, event_type || '-' || (CAST(floor(value) AS INTEGER) % 3) AS c, user_id FROM events), s AS (SELECT period, c, count(*) AS n FROM m GROUP BY ALL),
b AS (SELECT y.period, x.c AS before, y.c AS c, count(*) AS b FROM m x JOIN m y ON y.period = x.period + 1 AND y.user_id = x.user_id GROUP BY ALL), l AS (SELECT b.* FROM b JOIN s ON s.period = b.period AND s.c = b.c JOIN s o ON o.period = b.period - 1 AND o.c = b.before WHERE b >= 0.2 * (s.n + o.n - b)),
births AS (SELECT s.period, count(*) FILTER (WHERE k IS NULL) AS births, count(*) FILTER (WHERE k > 1) AS merges FROM s LEFT JOIN (SELECT period, c, count(*) AS k FROM l GROUP BY ALL) q USING (period, c) GROUP BY s.period),
deaths AS (SELECT s.period + 1 AS period, count(*) FILTER (WHERE k IS NULL) AS deaths, count(*) FILTER (WHERE k > 1) AS splits FROM s LEFT JOIN (SELECT period, before, count(*) AS k FROM l GROUP BY ALL) q ON q.period = s.period + 1 AND q.before = s.c GROUP BY s.period)
SELECT period, births, coalesce(deaths, 0) AS deaths, coalesce(splits, 0) AS splits, merges FROM births LEFT JOIN deaths USING (period)""")
def community_lifecycle(spark, d):
    x = t(spark, d, "events").select(F.floor(F.dayofmonth("ts") / 8).alias("period"), F.concat_ws("-", "event_type", (F.floor("value").cast("int") % 3).cast("string")).alias("c"), "user_id")
    return populations.lifecycle(x, "period", "c", "user_id")
