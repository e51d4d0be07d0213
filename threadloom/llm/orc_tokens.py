"""Token-id output as ORC: run-length encoded id columns, row indexes, Bloom filters on ``doc_id``.

Documents are range-partitioned and sorted by ``doc_id``, encoded inside the sorted partitions and written as one ORC file a
partition, so stripes hold consecutive ids and their statistics prune. ``ids`` is an integer list, which ORC stores in run-length
encoded blocks; the row index and the Bloom filter let a lookup by ``doc_id`` skip stripes and row groups, and any stripe can be
read alone, in parallel. Each row carries its start within its part, so a document's global start is that plus the total of the
parts before: one number a part, not a pass over the ids.

Defined results: a null or empty text has the end id alone; a null ``doc_id`` sorts first; repeated ids lie side by side, by
a hash of the text; an empty table writes no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import documents, fresh_path, no_cycles
from threadloom.llm.tokens import encoder

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}
#: Texts encoded between two batches of output.
BATCH = 64


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, own = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                piece = batch.slice(lo, BATCH)
                with no_cycles():
                    coded = [own.ids(t) + end for t in piece["text"].to_pylist()]
                sizes = np.array([len(c) // 2 for c in coded], dtype=np.int64)
                ends = np.cumsum(sizes)
                ids = np.frombuffer(b"".join(coded), dtype="<u2").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(coded), part, np.int32)), piece["doc_id"], pa.array(total + ends - sizes), pa.array(sizes), lists], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
                total += int(ends[-1])

    # bounds are sampled on the driver, so they must not hold texts: equal ids are parted by a hash
    keyed = documents(docs).withColumn("mark", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").drop("mark")
    ordered.mapInArrow(encode, SCHEMA).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, global ``start``, ``n_tokens`` and ``ids`` of every document in the files."""
    table = spark.read.schema(SCHEMA).orc(path)
    totals = sorted(map(tuple, table.groupBy("part").agg(F.sum("n_tokens")).collect()))  # one number a part
    before = [0, *accumulate(n for _, n in totals)]
    parts = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, before long")
    return table.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Some documents' ids; the filter on ``doc_id`` prunes stripes by statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            flat, at = np.asarray(lists.values).astype("<u4", copy=False), np.asarray(lists.offsets)
            crc = np.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the documents, read the files back, and return each document's place and checksum from them."""
    spark = docs.sparkSession
    path = fresh_path(spark, "orc-tokens")
    write_tokens(docs, path, vocabulary)
    return with_crc(read_tokens(spark, path))
