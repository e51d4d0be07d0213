"""Packing along a space-filling curve.

A document's hashed vector counts its 4-byte grams, each with a sign in every dimension from its hash; the mean sign projects it
to DIMS dimensions. Quantised coordinates become a Hilbert key, so documents of like text lie near each other on the curve. The
documents are range-sorted by (key, doc_id) across partitions, encoded in that order and laid end to end; the stream is cut
every ``length`` tokens. Only the last sequence is padded. Each partition knows its own offsets, and the global ones follow from one
total a partition.

Defined results: a null or empty text is the end id alone; copies have one key and split over partitions by ``doc_id``; repeated
rows are packed each; an empty table packs nothing; other columns are ignored. A very long text is cut into as many pieces as needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import documents, materialise, no_cycles
from threadloom.llm.tokens import encoder

LENGTH = 2048
DIMS, BITS = 3, 10
GRAM = 4
#: Spreads mean signs, mostly within a tenth of zero, over the axis.
SPREAD = 8.0


def project(texts: list[bytes]) -> np.ndarray:
    """Coordinates (documents x DIMS) in 0 .. 2**BITS - 1."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + GRAM)
    flat = np.frombuffer((b"\x00" * GRAM).join([*texts, b""]), dtype=np.uint8).astype(np.uint32)
    if not len(flat):
        return np.zeros((0, DIMS), dtype=np.int64)
    grams = flat.copy()
    for k in range(1, GRAM):
        grams[:-k] = (grams[:-k] << np.uint32(8)) | flat[k:]
    mixed = grams * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    mixed >>= np.uint32(20)
    starts = np.r_[0, ends[:-1]]
    sums = [np.add.reduceat(((mixed >> np.uint32(d)) & np.uint32(1)).astype(np.int64), starts) for d in range(DIMS)]
    mean = 2 * np.stack(sums, axis=1) / np.maximum(sizes + GRAM, 1)[:, None] - 1
    place = 0.5 + np.arctan(SPREAD * mean) / np.pi
    return np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``points``: undo the excess rotations from the top bit down, then Gray-decode."""
    x = points.T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for d in range(dims):
            flip = (x[d] & high) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[dims - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(points.shape[0], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def curve_keys(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, a hash of the text and the Hilbert key of its hashed vector."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                key = hilbert_key(project([t.encode() for t in piece["text"].to_pylist()]))
                yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["text"], piece["mark"], pa.array(key)], names=["doc_id", "text", "mark", "curve"])

    return documents(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(keys, "doc_id long, text string, mark long, curve long")


def token_stream(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Documents in curve order with their ids (16-bit, little-endian) and their start within their partition; written once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, own = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                with no_cycles():
                    coded = [own.ids(t) + end for t in piece["text"].to_pylist()]
                sizes = np.array([len(c) // 2 for c in coded], dtype=np.int64)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(coded), part, np.int32)), piece["doc_id"], pa.array(total + ends - sizes), pa.array(coded, pa.binary())], names=["part", "doc_id", "local_start", "ids"])
                total += int(ends[-1])

    # bounds are sampled on the driver, so they must not hold texts: rows with one key and id are parted by a hash
    order = ("curve", "doc_id", "mark")
    sorted_docs = curve_keys(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(sorted_docs.mapInArrow(encode, "part int, doc_id long, local_start long, ids binary"), "token-stream")


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 1) -> DataFrame:
    """Pieces: ``doc_id``, ``start`` and ``length`` in the document, ``doc_tokens``, ``sequence_id``, ``offset`` in it, and ``ids`` as
    little-endian unsigned 32-bit integers. Written sequences have ``length`` tokens, but for the last."""
    stream = token_stream(docs, vocabulary, end_id)
    sized = stream.select("part", (F.octet_length("ids") / 2).cast("long").alias("n"))
    totals = sorted(map(tuple, sized.groupBy("part").agg(F.sum("n")).collect()))  # one number a partition
    before = dict(zip((p for p, _ in totals), [0, *accumulate(n for _, n in totals)], strict=False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for part, doc, local, ids in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "local_start", "ids")), strict=True):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                n, at, done = len(ids) // 2, before[part] + local, 0
                while done < n:
                    take = min(n - done, length - (at + done) % length)
                    rows.append((doc, done, take, n, (at + done) // length, (at + done) % length, wide[4 * done : 4 * (done + take)]))
                    done += take
            for lo in range(0, len(rows), 2000):
                columns = list(zip(*rows[lo : lo + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return stream.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    return pack(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
