"""Benchmark decontamination: spaced-seed hashing; DataFrame functions only.

A seed is a span of SPAN consecutive words of which a fixed mask keeps some and ignores the others, so a substituted
word spoils only the seeds whose mask keeps it. Benchmark seeds are hashed once; every position of every document is
hashed under each mask and looked up. Around a hit every aligned window of WINDOW words that covers the seed is compared, and the hit
counts when AGREE of the words of one are equal, so up to a fifth may be substituted. Items shorter than the window are
compared over their whole length, at the same share. Any two substituted words in a passage of 13 leave a seed whole
(all 78 cases are found, by enumeration in the tests).

The benchmark side is broadcast only if its number of seeds is at most SEED_BOUND (counted first; about 64 MB); beyond it
the lookup is a shuffled join on the seed hash. Either way only places meet seeds; the words are fetched for the hits alone.

Defined results: words are runs of non-blanks in lower case; null and empty texts, and documents shorter than a seed, are
never contaminated; benchmark items shorter than a seed can't be told from chance and never match; a very long text is a row a word and mask, never
a larger unit; repeated rows are judged each by their text; an empty benchmark leaves all documents clean; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import boxed, documents, field, materialise

SPAN = 9
#: Kept positions of each mask. Any single substitution leaves a mask untouched at most offsets.
MASKS = ((0, 1, 3, 5, 8), (0, 2, 3, 7, 8), (0, 4, 5, 6, 8))
WINDOW = 13
AGREE = 0.8
SEED_BOUND = 400_000
#: Texts with a hit whose keys (16 bytes each) may be broadcast to fetch their words.
HIT_BOUND = 200_000
#: Windows over a seed begin up to so many words before it.
SLACK = WINDOW - SPAN


def words(text: Column) -> Column:
    """Lower-case runs of non-blanks; a text without any has one empty word."""
    return F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def seeds(word) -> Column:
    """A struct (mask, hash) for each mask, of the span whose k-th word is ``word(k)``."""
    return F.array(*[F.struct(F.lit(m).alias("mask"), F.xxhash64(F.lit(m), *[word(k) for k in mask]).alias("seed")) for m, mask in enumerate(MASKS)])


def spans(tokens: str) -> Column:
    """Every SPAN consecutive words as a struct ``w0``, ``w1``, ...: exploding it carries the words of a span, never of the text."""
    many = F.greatest(F.size(tokens) - SPAN + 1, F.lit(0))
    return F.arrays_zip(*[F.slice(tokens, 1 + k, many).alias(f"w{k}") for k in range(SPAN)])


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """Each seed of each item, with the words that any window over it may hold (``near``, null outside the item) and how many must agree."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    at = items.where(F.size("w") >= SPAN).select("item_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - SPAN)).alias("p"))
    near = F.array(*[F.when(F.col("p") + k >= 0, F.get("w", F.greatest(F.col("p") + k, F.lit(0)))) for k in range(-SLACK, WINDOW)])
    need = F.ceil(F.least(F.size("w"), F.lit(WINDOW)) * AGREE).cast("int")
    placed = at.select("item_id", near.alias("near"), need.alias("need"), F.explode(seeds(lambda k: F.get("w", F.col("p") + k))).alias("s"))
    return placed.select(F.col("s.seed").alias("seed"), "item_id", "near", "need").distinct()


def best_window(w: Column, at: Column, near: Column) -> Column:
    """Of all windows that cover the seed at ``at``: the most words in which both sides agree, and where the first such window begins."""
    same = F.transform(near, lambda x, i: F.when((at + i - SLACK >= 0) & (F.get(w, F.greatest(at + i - SLACK, F.lit(0))) == x), 1).otherwise(0))
    totals = F.transform(F.sequence(F.lit(0), F.lit(SLACK)), lambda j: F.struct(F.aggregate(F.slice(same, j + 1, WINDOW), F.lit(0), lambda a, x: a + x).alias("agree"), (-j).alias("back")))
    best = F.array_max(totals)
    return F.struct(best["agree"].alias("agree"), (at - SLACK - best["back"]).alias("at"))


def document_hits(docs: DataFrame, benchmark: DataFrame, bound: int | None = None) -> DataFrame:
    """Verified hits: ``doc_id``, ``mark`` (hash of the text), ``item_id``, word position and number of agreeing words."""
    known = benchmark_seeds(benchmark)
    if known.count() <= (SEED_BOUND if bound is None else bound):
        known = F.broadcast(known)
    text = documents(docs).select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w"))
    spots = text.select("doc_id", "mark", F.posexplode(spans("w")).alias("at", "span"))
    hashed = spots.select("doc_id", "mark", "at", F.explode(seeds(lambda k: F.col(f"span.w{k}"))).alias("s")).select("doc_id", "mark", "at", F.col("s.seed").alias("seed"))
    hits = materialise(hashed.join(known, "seed").drop("seed"), "seed-hits")
    keys = hits.select(F.col("doc_id").alias("id"), F.col("mark").alias("its")).distinct()
    if keys.count() <= HIT_BOUND:
        keys = F.broadcast(keys)
    hit = text.join(keys, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("its"))).select("id", "its", "w").dropDuplicates(["id", "its"])
    met = hits.join(hit, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("its")))
    found = met.withColumn("best", best_window(F.col("w"), F.col("at"), F.col("near"))).where(F.col("best.agree") >= F.col("need"))
    return found.select("doc_id", "mark", "item_id", F.col("best.at").alias("at"), F.col("best.agree").alias("agree"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each contaminated text: the items found in it, the number of verified windows and the words they span."""
    windows = document_hits(docs, benchmark).groupBy("doc_id", "mark", "item_id", "at").agg(F.max("agree").alias("agree"))
    items = windows.groupBy("doc_id", "mark", "item_id").agg(F.count(F.lit(1)).alias("windows"), F.min("at").alias("first"), F.max("at").alias("last"))
    return items.groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_list("item_id")).alias("items"), F.sum("windows").alias("windows"), F.min("first").alias("first_word"), (F.max("last") + WINDOW).alias("end_word")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, unchanged, that hold no passage of the benchmark."""
    found = contamination(docs, benchmark).select(F.col("doc_id").alias("id"), F.col("mark").alias("its"))
    rows = boxed(docs)
    clean = rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (F.xxhash64(rows["text"]) == found["its"]), "left_anti")
    return clean.select(*[field(c) for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: ``contaminated``, the items found, and where."""
    found = contamination(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "items", "windows", "first_word", "end_word")
    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("mark"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["mark"] == found["_mark"]), "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
        F.coalesce("windows", F.lit(0)).cast("long").alias("windows"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("end_word").cast("long").alias("end_word"),
    )
