"""Scans and sinks of text records: JSON lines with exact line numbers, label sheets, code sheets, reply trees, checksums."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

BAD = "_unparsed"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``source_file``, ``source_line`` (from 1) and ``value`` of every line. Files stay split: a line's number is its place in its
    split plus the lines of the splits before, so no file has to fit one task."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_at")).withColumn("_order", F.monotonically_increasing_id())
    own = F.row_number().over(Window.partitionBy("source_file", "_at").orderBy("_order"))
    splits = rows.groupBy("source_file", "_at").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(splits.withColumn("_before", before), ["source_file", "_at"]).select("source_file", (F.col("_own") + F.col("_before")).cast("long").alias("source_line"), "value")


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records with their file and line; blank lines are skipped, and a line that is not JSON fails the job by name and number."""
    wide = StructType([*schema.fields, StructField(BAD, StringType())])
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", wide, {"columnNameOfCorruptRecord": BAD}))
    where = F.concat(F.lit("not JSON at "), "source_file", F.lit(":"), F.col("source_line").cast("string"))
    checked = parsed.withColumn("_r", F.when(F.col(f"_r.{BAD}").isNull(), F.col("_r")).otherwise(F.raise_error(where)))
    return checked.select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields], "source_file", "source_line")


def label_sheet(spark: SparkSession, path: str, columns: list[str], domains: dict[str, list[str]]) -> DataFrame:
    """A CSV of labels, all strings; an empty cell is the empty string, and a value outside its column's domain fails the job."""
    read = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in columns), enforceSchema=False, multiLine=True, escape='"').fillna("")
    for c, allowed in domains.items():
        wrong = F.concat(F.lit(f"{c} holds "), F.col(c))
        read = read.withColumn(c, F.when(F.col(c).isin(allowed), F.col(c)).otherwise(F.raise_error(wrong)))
    return read


def code_sheet(spark: SparkSession, path: str) -> DataFrame:
    """``item`` and its sorted ``codes`` from lines of ``item:LETTERS``; text after ``#`` and blank lines do not count."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    pair = F.split(line, ":", 2)
    letters = F.split(F.upper(F.regexp_replace(pair[1], r"\s", "")), "")
    return spark.read.text(path).where(line != "").select(F.trim(pair[0]).alias("item"), F.array_sort(F.array_distinct(F.filter(letters, lambda c: c != ""))).alias("codes"))


def tree_rows(trees: DataFrame, key: str, nested: str) -> DataFrame:
    """Flatten nested JSON listings (``kind`` Listing, t1 or more) to one row a node: parent, depth, kind and the collapsed count."""

    def walk(text: str | None) -> Iterator[tuple]:
        queue = [(json.loads(text), None, 0)] if text else []
        while queue:
            node, parent, depth = queue.pop()
            kind, data = node.get("kind"), node.get("data") or {}
            if kind == "Listing":
                queue.extend((child, parent, depth) for child in reversed(data.get("children") or []))
                continue
            known = kind if kind in ("t1", "more") else "unknown"
            yield data.get("id"), parent, depth, known, int(data.get("count") or 0)
            if isinstance(data.get("replies"), dict):
                queue.append((data["replies"], data.get("id"), depth + 1))

    def flatten(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(k, *row) for k, text in zip(part[key], part[nested], strict=True) for row in walk(text)]
            yield pd.DataFrame(found, columns=[key, "id", "parent_id", "depth", "kind", "hidden"])

    return trees.select(key, nested).mapInPandas(flatten, StructType([trees.schema[key], *StructType.fromDDL("id string, parent_id string, depth int, kind string, hidden long").fields]))


def task_grid(spark: SparkSession, dims: dict[str, list[str]]) -> DataFrame:
    """Every combination of some configured dimensions, as collection tasks."""
    return spark.createDataFrame(list(product(*dims.values())), ", ".join(f"{c} string" for c in dims))


def unseen(rows: DataFrame, sink: DataFrame, key: str) -> DataFrame:
    """Rows whose key the sink does not hold yet, each key once."""
    return rows.dropDuplicates([key]).join(sink.select(key).distinct(), key, "left_anti")


def merged_routes(rows: DataFrame, key: str, route: str) -> DataFrame:
    """Each key once, with the sorted distinct routes by which it came."""
    pairs = rows.select(key, route).distinct()
    return pairs.groupBy(key).agg(F.array_sort(F.collect_list(route)).alias("routes"))


def completion(tasks: DataFrame, group: list[str], state: str, done: str, failed: str) -> DataFrame:
    return tasks.groupBy(*group).agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col(state) == done).alias("complete"), F.count_if(F.col(state) == failed).alias("failed")).withColumn("finished", F.col("complete") == F.col("tasks"))


def discovered(rows: DataFrame, author: str, order: list[str], handle: str, strong) -> DataFrame:
    """Authors with the first handle seen, their rows, and whether any row came by the stronger route."""
    first = F.min_by(handle, F.struct(*order))
    return rows.groupBy(author).agg(first.alias("first_handle"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.bool_or(strong), F.lit(False)).alias("strong"))


def write_both(df: DataFrame, path: str, parts: int | None = None) -> dict:
    """Parquet and CSV copies of a table and a manifest of its columns and rows, counted on the written Parquet."""
    spark = df.sparkSession
    (df.coalesce(parts) if parts else df).write.mode("overwrite").parquet(f"{path}/parquet")
    back = spark.read.schema(df.schema).parquet(f"{path}/parquet")
    back.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    manifest = {"columns": dict(back.dtypes), "rows": back.count()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 and length of each file below a path. Spark reads each whole file as one value, so files stay below 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def roll_up(sums: DataFrame) -> DataFrame:
    """One checksum of a set of files, whatever their order; the files of a manifest are few."""
    return sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "file", "sha256"))), "\n"), 256).alias("sha256"), F.sum("bytes").alias("bytes"))
