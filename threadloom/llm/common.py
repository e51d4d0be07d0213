"""Shared plumbing of the training-data operators.

Intermediate tables are written to the folder that the cluster names in ``spark.checkpoint.dir``; every
executor sees it, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from inspect import signature

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.fixpoint import saved, shared_folder

#: Characters that separate words: space and the five ASCII control spaces.
BLANKS = " \t\n\x0b\x0c\r"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/threadloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back: lineage is cut there, and the shuffle files go."""
    return saved(df, label, codec)


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the table has; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def boxed(docs: DataFrame) -> DataFrame:
    """``documents`` with the whole row in the struct ``row``, so that no name of the table's own can clash with a working column."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def field(name: str) -> Column:
    """A column of the table in its ``boxed`` row."""
    return F.col("row").getField(name).alias(name)


def fold(column: Column, parts: int) -> Column:
    """A part number from a 64-bit hash."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts_for(rows: int, each: int, least: int = 1) -> int:
    """How many groups hold ``rows`` rows at about ``each`` rows a group."""
    return max(least, -(-rows // each))


@contextmanager
def no_cycles() -> Iterator[None]:
    """For work that makes many objects and no cycles: the collector is off meanwhile."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_caches: list[dict] = []


def process_cache() -> dict:
    """A dict that a worker process keeps from task to task, until a stage of another kind calls ``forget``."""
    _caches.append({})
    return _caches[-1]


def forget() -> None:
    """Drop what earlier stages cached in this worker process, and give the memory back."""
    for cache in _caches:
        cache.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker is kept for later tasks, and so would be the pages of its greatest moment."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without this call keeps its pages
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(f: Callable) -> Callable:
    """``f``, of one group's table or of two, beginning and ending with freed memory given back."""

    def call(*tables):
        give_back()
        out = f(*tables)
        give_back()
        return out

    return (lambda a, b: call(a, b)) if len(signature(f).parameters) == 2 else (lambda a: call(a))  # Spark reads the number of arguments
