"""Wide series sheets and CSV dimensions.

A wide sheet is one small CSV file as its publisher exports it: some lines of talk, a header row somewhere, date columns and value columns
side by side. Files are read by Spark as they are, one row a file, and cut into cells; all the rest is expressions over the cells.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from threadloom.functions.unicode import country, folded_header, is_date_header, trend_value

#: Encodings tried in turn; the last needs its byte order mark.
ENCODINGS = ("utf-8-sig", "utf-16")
#: Fixed value: countries that a header row names at least.
LEAST_COUNTRIES = 4


def _text(data: bytes) -> str | None:
    for encoding in ENCODINGS:
        if encoding == "utf-16" and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """``source_file``, ``row`` (from 0) and ``cells`` of every CSV row; a file in none of the encodings fails the job by its name."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                text = _text(data)
                if text is None:
                    raise ValueError(f"cannot decode {name}")
                rows = list(csv.reader(io.StringIO(text, newline="")))
                yield pd.DataFrame({"source_file": name, "row": range(len(rows)), "cells": rows})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cut, "source_file string, row int, cells array<string>")


def _indices(flags: Column) -> Column:
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())


def wide_series(cells: DataFrame) -> DataFrame:
    """``source_file``, ``row``, ``country``, ``date`` (text) and ``value`` of sheets whose header names a date and four countries.

    The header is a file's first such row. A country's values are dated by the nearest date column before them, or else by the first;
    a row without a date is left out, a file without a header fails the job by its name.
    """
    names = cells.select("source_file", "row", F.posexplode("cells").alias("at", "cell")).select("source_file", "row", "at", folded_header(F.col("cell")).alias("name"))
    kinds = names.select("source_file", "row", "at", is_date_header(F.col("name")).alias("is_date"), country(F.col("name")).alias("country"))
    rows = kinds.groupBy("source_file", "row").agg(F.count_if("is_date").alias("dates"), F.count("country").alias("countries"), F.sort_array(F.collect_list(F.struct("at", "is_date", "country"))).alias("header"))  # a row's cells
    fit = (F.col("dates") >= 1) & (F.col("countries") >= LEAST_COUNTRIES)
    tops = rows.groupBy("source_file").agg(F.min_by(F.struct("row", "header"), F.when(fit, F.col("row"))).alias("top"))
    none = F.raise_error(F.concat(F.lit("no header row in "), "source_file"))
    headers = tops.select("source_file", F.coalesce("top.row", none).alias("top"), "top.header")  # a row a file
    known = cells.join(F.broadcast(headers), "source_file")
    dates = F.transform(F.filter("header", lambda h: h["is_date"]), lambda h: h["at"])
    series = F.transform(F.filter("header", lambda h: h["country"].isNotNull()), lambda h: F.struct(h["at"].alias("at"), h["country"].alias("country")))
    body = known.select("source_file", "row", "top", "cells", dates.alias("dates"), F.explode(series).alias("s"))
    before = F.filter("dates", lambda d: d < F.col("s.at"))
    dated = F.when(F.size(before) > 0, F.element_at(before, -1)).otherwise(F.element_at("dates", 1))
    cell = lambda at: F.trim(F.coalesce(F.get("cells", at), F.lit("")))
    out = body.where(F.col("row") > F.col("top")).select("source_file", "row", F.col("s.country").alias("country"), cell(dated).alias("date"), trend_value(cell(F.col("s.at"))).alias("value"))
    return out.where("date <> ''")


def dimension(spark: SparkSession, path: str, schema: StructType, key: str, ordered: tuple[str, str] | None = None) -> DataFrame:
    """A CSV dimension: columns by header, dates read strictly, ``key`` present and unique; ``ordered`` names a start and a later end.

    A header of other columns, a cell that does not parse and a broken rule fail the job. Dimensions are small; one window holds a key.
    """
    read = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST", dateFormat="yyyy-MM-dd", timestampFormat="yyyy-MM-dd'T'HH:mm:ssXXX")
    many = F.count(F.lit(1)).over(Window.partitionBy(key))
    rule = F.when(F.col(key).isNull(), F.lit(f"{key} is missing")).when(many > 1, F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string")))
    if ordered:
        rule = rule.when(~(F.col(ordered[0]) < F.col(ordered[1])), F.concat(F.lit(f"{ordered[0]} is not before {ordered[1]}: "), F.col(key).cast("string")))
    checked = read.withColumn(key, F.when(rule.isNull(), F.col(key)).otherwise(F.raise_error(rule)))
    return checked.select(*[f.name for f in schema.fields])
