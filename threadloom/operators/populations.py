"""Populations: coverage, masks, corpus flags, copy-paste and wave detection, account classes, audits and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coverage_row(rows: DataFrame, scope: list[str], strict: Column, inclusive: Column, unsure: Column, author: str, container: str) -> DataFrame:
    """Rows, strict and inclusive ones, uncertain ones, and distinct authors and containers of the strict ones."""
    return rows.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(strict).alias("strict"), F.count_if(inclusive).alias("inclusive"), F.count_if(unsure).alias("uncertain"),
        F.countDistinct(F.when(strict, F.col(author))).alias("authors"), F.countDistinct(F.when(strict, F.col(container))).alias("containers"),
    )


def population_counts(rows: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """How many rows each named population has; one pass."""
    counts = [F.struct(F.lit(name).alias("population"), F.count_if(F.coalesce(mask, F.lit(False))).alias("n")) for name, mask in masks.items()]
    return rows.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def robustness_filter(rows: DataFrame, name: str, filters: dict[str, tuple[list[str], Column]]) -> DataFrame:
    """The rows of a named filter; a filter whose columns the table lacks is an error, never an empty result."""
    needs, mask = filters[name]
    lacking = [c for c in needs if c not in rows.columns]
    if lacking:
        raise ValueError(f"{name} needs {', '.join(lacking)}")
    return rows.where(mask)


def corpus_flags(rows: DataFrame, author: str, urls: Column, tokens: Column, promo: Column, name: Column) -> DataFrame:
    """Counts of the author's rows, link-heavy and bot flags, and reasons for spam."""
    bot = F.lower(name).rlike(r"(^|[_-])bot($|[_-])|automod|moderator")
    heavy = (urls >= 2) | ((urls >= 1) & (tokens <= 4))
    reasons = F.array_compact(F.array(F.when(promo & (urls >= 1), "promo_link"), F.when(urls >= 3, "many_urls"), F.when(bot & heavy, "bot_link_pattern")))
    many = F.when(F.coalesce(F.col(author).cast("string"), F.lit("")) != "", F.count(F.lit(1)).over(Window.partitionBy(author))).otherwise(0)
    return rows.withColumns({"author_rows": many, "link_heavy": heavy, "bot": bot, "spam_reasons": F.array_join(reasons, "|")})


def copy_paste(rows: DataFrame, author: str, norm: Column, order: list[str], shared_chars: int = 20, repeat_chars: int = 30) -> DataFrame:
    """How many authors posted a text (long enough ones), and whether a row repeats its author's earlier one."""
    keyed = rows.withColumn("_text", F.sha2(norm, 256)).withColumn("_chars", F.length(norm))
    authors = keyed.where(F.col("_chars") >= shared_chars).groupBy("_text").agg(F.countDistinct(author).alias("copy_authors"))
    again = F.row_number().over(Window.partitionBy(author, "_text").orderBy(*order)) > 1
    return keyed.join(authors, "_text", "left").withColumn("copy_authors", F.coalesce("copy_authors", F.lit(0))).withColumn("repeats_own", again & (F.col("_chars") >= repeat_chars)).drop("_text", "_chars")


def wave_days(rows: DataFrame, day: str, part: Column, share: float = 0.20, volume: float = 2.0) -> DataFrame:
    """Days on which the part has a large share of the rows and the volume is a multiple of the median day's."""
    days = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.count_if(part).alias("part"))
    middle = days.agg(F.median("n").alias("middle"))
    joined = days.crossJoin(F.broadcast(middle))  # one row
    return joined.select(day, "n", "part", ((F.col("part") / F.col("n") >= share) & (F.col("n") / F.col("middle") >= volume)).alias("wave"))


def account_classes(authors: DataFrame) -> DataFrame:
    """The strongest class of each account, from ``total``, ``repeats``, ``days``, ``labelled_spam``, ``labelled_bot`` and ``bridged``."""
    ratio = F.when(F.col("total") > 0, F.col("repeats") / F.col("total")).otherwise(0.0)
    rate = F.when(F.col("days") > 0, F.col("total") / F.col("days")).otherwise(0.0)
    kind = (
        F.when(F.col("labelled_spam"), "labelled_spam")
        .when(F.col("labelled_bot"), "labelled_bot")
        .when(F.col("bridged"), "bridged")
        .when((F.col("total") >= 20) & (ratio >= 0.5), "repeater")
        .when((rate >= 10) & (F.col("total") >= 50), "high_volume")
        .otherwise("ordinary")
    )
    return authors.withColumns({"repeat_ratio": ratio, "rate": rate, "class": kind})


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule: how many rows break it. A null verdict breaks it too."""
    return population_counts(rows, {name: ~F.coalesce(ok, F.lit(False)) for name, ok in rules.items()}).withColumnsRenamed({"population": "rule", "n": "violations"})


def quality_gates(rows: DataFrame, gates: dict[str, tuple[Column, float]]) -> DataFrame:
    """Each gate's value (an aggregate) and whether it reaches its least value."""
    out = [F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), (value >= least).alias("passed")) for name, (value, least) in gates.items()]
    return rows.agg(F.array(*out).alias("g")).select(F.explode("g").alias("g")).select("g.*")


def first_window(rows: DataFrame, at: Column, windows: DataFrame, key: str) -> DataFrame:
    """The first window (by start) that holds each row, else ``none``. The windows are a small dimension, packed into one array."""
    packed = windows.agg(F.array_sort(F.collect_list(F.struct("start", "end", "scope"))).alias("_w"))
    hits = lambda: F.filter("_w", lambda w: (at >= w["start"]) & (at < w["end"]))
    return rows.crossJoin(F.broadcast(packed)).withColumn("scope", F.coalesce(F.get(hits(), F.lit(0))["scope"], F.lit("none"))).drop("_w")  # one row


def case_window(rows: DataFrame, at: Column, windows: DataFrame) -> DataFrame:
    """As ``first_window``, but more than one window for a row is an error."""
    packed = windows.agg(F.array_sort(F.collect_list(F.struct("start", "end", "scope"))).alias("_w"))
    held = rows.crossJoin(F.broadcast(packed)).withColumn("_h", F.filter("_w", lambda w: (at >= w["start"]) & (at < w["end"])))  # one row
    scope = F.when(F.size("_h") > 1, F.raise_error(F.lit("case windows overlap")).cast("string")).otherwise(F.coalesce(F.get("_h", F.lit(0))["scope"], F.lit("none")))
    return held.withColumn("scope", scope).drop("_w", "_h")


def window_flow(rows: DataFrame, at: Column, start: str, end: str) -> DataFrame:
    """Rows inside a half-open window, outside it, and without a valid time."""
    inside = (at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp"))
    return rows.agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"), F.count_if(at.isNull()).alias("invalid"))


def label_shares(rows: DataFrame, scope: list[str], labels: Column, names: list[str]) -> DataFrame:
    """The share of rows that carry each label; rows may carry several."""
    long = rows.groupBy(*scope).agg(*[F.avg(F.array_contains(labels, n).cast("double")).alias(n) for n in names])
    return long.select(*scope, F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("share")) for n in names])).alias("s")).select(*scope, "s.*")


def quota_top(rows: DataFrame, group: list[str], kind: str, order: list[Column], least: int, most: int) -> DataFrame:
    """Up to ``least`` rows of each kind by the order, then the best others until the group has ``most``."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group, kind).orderBy(*order)))
    chosen = first.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy((F.col("_k") > least).cast("int"), *order)))
    return chosen.where(F.col("_r") <= most).drop("_k", "_r")


def lifecycle(members: DataFrame, period: str, community: str, member: str, least: float = 0.20) -> DataFrame:
    """Births, deaths, splits and merges between consecutive periods (integers), communities matched at Jaccard ``least``."""
    sets = members.select(period, community, member).distinct()
    sizes = sets.groupBy(period, community).agg(F.count(F.lit(1)).alias("n"))
    a = sets.select((F.col(period) + 1).alias(period), F.col(community).alias("before"), member)
    both = a.join(sets, [period, member]).groupBy(period, "before", community).agg(F.count(F.lit(1)).alias("both"))
    older = sizes.select((F.col(period) + 1).alias(period), F.col(community).alias("before"), F.col("n").alias("m"))
    links = both.join(sizes, [period, community]).join(older, [period, "before"]).where(F.col("both") >= least * (F.col("n") + F.col("m") - F.col("both")))
    first = sizes.agg(F.min(period).alias("lo"), F.max(period).alias("hi"))
    now = sizes.join(links.groupBy(period, community).agg(F.count(F.lit(1)).alias("k")), [period, community], "left").groupBy(period).agg(F.count_if(F.col("k").isNull()).alias("births"), F.count_if(F.col("k") > 1).alias("merges"))
    gone = older.join(links.groupBy(period, "before").agg(F.count(F.lit(1)).alias("k")), [period, "before"], "left").groupBy(period).agg(F.count_if(F.col("k").isNull()).alias("deaths"), F.count_if(F.col("k") > 1).alias("splits"))
    whole = now.join(gone, period, "full").crossJoin(F.broadcast(first)).where((F.col(period) >= F.col("lo")) & (F.col(period) <= F.col("hi")))  # one row
    return whole.select(period, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("births", "deaths", "splits", "merges")])
