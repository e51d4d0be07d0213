"""Structured Streaming over file sources: day buckets, first-seen keys across restarts, sliding windows, lateness flags.

Every function takes and returns a DataFrame, streaming or not; ``drain`` runs what is there now and stops, and a later run with the
same checkpoint goes on from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_a_batch: int = 1000) -> DataFrame:
    """A stream of a table's Parquet files: one file of that name, or a folder of them."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def day_counts(rows: DataFrame, at: str, group: list[str], late: str | None = None) -> DataFrame:
    """Rows of each tumbling day; with ``late`` (a watermark) days close and state is bounded, without it no row is ever dropped."""
    timed = rows.withWatermark(at, late) if late else rows
    return timed.groupBy(F.window(at, "1 day").alias("w"), *group).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), *group, "n")


def sliding_counts(rows: DataFrame, at: str, group: list[str], width: str = "7 days", step: str = "1 day") -> DataFrame:
    return rows.groupBy(F.window(at, width, step).alias("w"), *group).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("start"), *group, "n")


def first_seen(rows: DataFrame, keys: list[str], at: str | None = None, within: str | None = None) -> DataFrame:
    """Each key once across restarts; with ``within`` the state of keys older than the watermark goes."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(keys) if at and within else rows.dropDuplicates(keys)


def flag_late(rows: DataFrame, at: Column, anchor: Column, days: int = 90) -> DataFrame:
    """Rows more than ``days`` after, or before, their anchor are marked and kept."""
    gap = F.datediff(at, anchor)
    return rows.withColumn("is_late", F.coalesce(gap > days, F.lit(False))).withColumn("is_early", F.coalesce(gap < 0, F.lit(False)))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run a stream over all input there is and return what its sink then holds. Append goes to the exactly-once file sink; complete
    rewrites the result each batch, so a replayed batch changes nothing."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    query = writer.start()
    query.awaitTermination()
    return shape(spark.read.schema(stream.schema).parquet(path))
