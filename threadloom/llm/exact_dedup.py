"""Exact dedup: tree-merge of sorted digest runs.

Every input partition becomes a sorted run of digests. In each round a run joins the others of its binomial
block (``run >> FAN_BITS``): the runs of a block are merged on the digest, and each digest keeps its best
candidate and its count. After the last round one logical run, still spread over the cluster by digest, holds
each digest once. Winners then go down the tree: first to the leaf runs, where a digest has one row a run at
most, then to the documents of a run. So no join meets all copies of a text on one key, and merges pre-aggregate
before they shuffle. Digests are verified: a SHA-256 only merges with another if the normalised length and a
second, independent 64-bit hash agree too.

Defined results: a null text is empty; empty and blank texts form one group; a null ``doc_id`` loses every tie;
repeated rows stay separate rows, of which exactly one is kept; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import BLANKS, documents, materialise

#: A round merges 2 ** FAN_BITS runs into one.
FAN_BITS = 3
KEY = ["digest", "check", "size"]


def digest_runs(docs: DataFrame) -> DataFrame:
    """One row a document: its run, digest and what ranks it; written once, without texts."""
    bare = F.translate("text", BLANKS, "")
    rows = documents(docs).select(
        "doc_id",
        F.unhex(F.sha2(bare, 256)).alias("digest"),
        F.xxhash64(bare).alias("check"),
        F.octet_length(bare).alias("size"),
        F.length("text").alias("points"),
        F.monotonically_increasing_id().alias("row"),
    )
    return materialise(rows, "digests").withColumn("run", F.shiftright("row", 33))


def merge_rounds(leaves: DataFrame, runs: int) -> DataFrame:
    """Merge the leaf runs up the tree until one is left."""
    level = leaves
    while runs > 1:
        runs = -(-runs // (1 << FAN_BITS))
        level = (
            level.withColumn("run", F.shiftright("run", FAN_BITS))
            .groupBy("run", *KEY)
            .agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
        )
    return level


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Group documents whose texts agree without blanks; the longest original stays, then the smallest ``doc_id``."""
    table = digest_runs(docs)
    runs = (table.agg(F.max("run")).first()[0] or 0) + 1
    rank = F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    leaves = materialise(table.groupBy("run", *KEY).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("copies")), "runs")
    top = merge_rounds(leaves, runs).select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("copies").alias("group_size"))
    winners = leaves.select("run", *KEY).join(top, KEY)
    return table.join(winners, ["run", *KEY]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
