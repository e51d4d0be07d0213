"""Iterate-until-fixpoint plans. Each round is written to the shared checkpoint folder, so lineage stays short and a lost
executor costs one round's re-read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="threadloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark's own switch to remove a query's shuffle files once the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back; the shuffle files behind it go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/threadloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the folders of a ``saved`` table that nothing will read again; any other table is left alone."""
    spark = table.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own = f"{shared_folder(spark)}/threadloom/"
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if own.split("://")[-1].replace("//", "/") in folder:
            path.getFileSystem(conf).delete(path, True)


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], digest: Callable[[DataFrame], tuple], rounds: int = 100) -> DataFrame:
    """Apply ``step`` until ``digest`` of the saved state stays the same."""
    before = digest(state)
    for _ in range(rounds):
        state = saved(step(state), "round")
        now = digest(state)
        if now == before:
            return state
        before = now
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of the undirected ``edges`` (``a``, ``b``, ordered type).

    Alternating large-star and small-star rounds: neighbours are hung on the smallest known node until every component is a star.
    Rows never exceed the number of edges plus nodes, and hubs only meet joins against one row a key.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        hung = both.join(least, both["a"] == least["k"])
        if large:
            out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def digest(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    start = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    stars = fixpoint(start, lambda pairs: star(star(pairs, True), False), digest)
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
