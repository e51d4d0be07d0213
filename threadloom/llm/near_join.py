"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal sets of word shingles are one class; classes are compared, copies are not. MinHash bands propose candidates:
classes that share a band bucket are hung on the bucket's smallest class (a star, never all pairs), and the stars' connected
components bound where links can be. Inside a component, tiles of at most about TILE by TILE classes are compared in blocks:
lengths first, then MinHash values STEP at a time, dropping a pair as soon as the posterior probability that its similarity
reaches the threshold, under a uniform prior, falls below TOLERANCE; whatever survives is verified exactly on the shingle sets. A
tile returns counts and a spanning forest of its links, not pairs, and the forests' components are the groups.

With BANDS bands of ROWS values, a pair at the threshold of 0.8 misses every bucket with probability (1 - 0.8**5)**30, below 1e-5.

Defined results: words are lower-cased runs of non-blanks; a text of one to four words is one shingle; null and empty texts have none
and never link; a null ``doc_id`` ranks last in its group; repeated rows are copies; an empty table gives an empty table; a very long
text is hashed whole; other columns, whatever their names, are ignored by the report and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import boxed, documents, field, forget, give_back, materialise, parts_for, thrifty
from threadloom.llm.hashing import BASE, distinct, inside, mix, sequence_keys, word_keys
from threadloom.plans.fixpoint import connected_components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
STEP = 30
TOLERANCE = 1e-7
TILE = 256
#: Rows of tiles (a class in a tile pair) that one comparing task gets, about.
BIN_ROWS = 4_000
BITMAP_BITS = 27
LAST = (1 << 63) - 1
_VALUES = BANDS * ROWS
_KEYS = mix(np.arange(1, 2 * _VALUES + 1, dtype=np.uint64) * np.uint64(BASE))
_SCALE = (_KEYS[:_VALUES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OFFSET = (_KEYS[_VALUES:] >> np.uint64(32)).astype(np.uint32)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle keys of all texts, in order and with repeats, and how many each has."""
    words, counts = word_keys(texts)
    starts = np.flatnonzero(inside(counts, WORDS))
    keys = sequence_keys(words, WORDS)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
    sizes = np.maximum(counts - WORDS + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        first = np.r_[0, np.cumsum(counts)]
        whole = np.array([sequence_keys(words[first[i] : first[i + 1]], int(counts[i]))[0] + np.uint64(counts[i]) for i in short])
        keys = np.insert(keys, np.r_[0, np.cumsum(sizes)][short], whole)
        sizes[short] = 1
    return keys, sizes


def minhashes(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signatures (texts x values) as 32-bit numbers; texts without shingles have all ones."""
    out = np.full((len(sizes), _VALUES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        low = (keys >> np.uint64(32)).astype(np.uint32)
        work = np.empty_like(low)
        for k in range(_VALUES):
            np.multiply(low, _SCALE[k], out=work)
            work += _OFFSET[k]
            out[full, k] = np.minimum.reduceat(work, starts)
    return out


def _sets(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingles (of 48 bits, in texts of at most 2**16 a call), all keys, and sizes with repeats."""
    keys, sizes = shingles(texts)
    packed = distinct((np.repeat(np.arange(len(texts), dtype=np.uint64), sizes) << np.uint64(48)) | (keys >> np.uint64(16)))
    at = np.searchsorted(packed, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(48))
    own = packed & np.uint64((1 << 48) - 1)
    return [own[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], keys, sizes


def _class_key(own: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(own + np.uint64(BASE)), dtype=np.uint64) + np.uint64(len(own))]))[0].view(np.int64))


def _lower(column: pa.Array) -> list[bytes]:
    return [t.lower().encode() for t in column.to_pylist()]


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            own, keys, sizes = _sets(_lower(part["text"]))
            signs = minhashes(keys, sizes)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["mark"], pa.array([_class_key(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int32()), pa.array([s.tobytes() for s in signs], pa.binary())],
                names=["doc_id", "mark", "node", "size", "signature"],
            )


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each band of each class."""
    weight = mix(np.arange(1, ROWS + 1, dtype=np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch["signature"].to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = mix((mix(signs + np.uint64(BASE)) * weight).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch["node"].take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], names=["bucket", "node"])


@lru_cache(maxsize=None)
def least_matches(seen: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values among ``seen`` for which the posterior of reaching the threshold is not below the tolerance."""
    tail = 0.0
    for m in range(seen + 1):
        tail += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if tail >= tolerance:
            return m
    return seen


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of some pairs; many pairs go through blocks of an incidence matrix."""
    if len(pairs) < 64:
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in pairs], dtype=np.int64)
    flat = np.concatenate([*a, *b])
    vocabulary, code = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    total = np.zeros((len(a), len(b)), dtype=np.float64)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for lo in range(0, len(vocabulary), 8192):
        left, right = np.searchsorted(code, [lo, lo + 8192])
        block = np.zeros((len(a) + len(b), min(8192, len(vocabulary) - lo)), dtype=np.float32)
        block[row[left:right], code[left:right] - lo] = 1
        total += block[: len(a)] @ block[len(a) :].T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def linked(a_sign: np.ndarray, a_set: list, b_sign: np.ndarray, b_set: list, same: bool) -> np.ndarray:
    """Index pairs whose exact Jaccard reaches the threshold; ``same`` compares a tile with itself, each pair once."""
    na, nb = np.array([len(x) for x in a_set]), np.array([len(x) for x in b_set])
    small, large = np.minimum.outer(na, nb), np.maximum.outer(na, nb)
    alive = (small >= THRESHOLD * large - 1e-9) & (small > 0)
    if same:
        alive &= np.triu(np.ones(alive.shape, dtype=bool), 1)
    pairs = np.argwhere(alive)
    matches = np.zeros(len(pairs), dtype=np.int64)
    for lo in range(0, _VALUES, STEP):
        if not len(pairs):
            return pairs
        hi = lo + STEP
        for at in range(0, len(pairs), 100_000):
            own = pairs[at : at + 100_000]
            matches[at : at + 100_000] += (a_sign[own[:, 0], lo:hi] == b_sign[own[:, 1], lo:hi]).sum(axis=1)
        keep = matches >= least_matches(hi)
        pairs, matches = pairs[keep], matches[keep]
    if not len(pairs):
        return pairs
    both = _overlaps(a_set, b_set, pairs)
    union = na[pairs[:, 0]] + nb[pairs[:, 1]] - both
    return pairs[both >= THRESHOLD * union - 1e-9]


LINKS = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def compare_bin(table: pa.Table) -> pa.Table:
    """Links of all tile pairs of a bin: for each class its partners' documents in the tile, and one edge to its tree's root."""
    comp, i, j, side, node, weight = (np.asarray(table[c]) for c in ("component", "i", "j", "side", "node", "weight"))
    signs = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint32).reshape(-1, _VALUES)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table["shingles"].to_pylist()]
    order = np.lexsort((side, j, i, comp))
    heads = np.flatnonzero(np.r_[True, (np.diff(comp[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)])
    out: tuple[list, list, list] = ([], [], [])
    for lo, hi in zip(heads, np.r_[heads[1:], len(order)], strict=True):
        rows = order[lo:hi]
        same = i[rows[0]] == j[rows[0]]
        left, right = (rows, rows) if same else (rows[side[rows] == 0], rows[side[rows] == 1])
        pairs = linked(signs[left], [sets[r] for r in left], signs[right], [sets[r] for r in right], bool(same)) if len(left) and len(right) else np.zeros((0, 2), int)
        if not len(pairs):
            continue
        a, b = left[pairs[:, 0]], right[pairs[:, 1]]
        links: dict[int, int] = {}
        root: dict[int, int] = {}
        for x, y in ((a, b), (b, a)):
            own, at = np.unique(x, return_inverse=True)
            for r, n in zip(own.tolist(), np.bincount(at, weight[y]).astype(np.int64).tolist(), strict=True):
                links[r] = links.get(r, 0) + n

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
        for r, n in links.items():
            for column, value in zip(out, (int(node[r]), int(node[find(r)]), n), strict=True):
                column.append(value)
    return pa.table([pa.array(c, pa.int64()) for c in out], schema=LINKS)


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """Candidate classes as a bitmap of fixed size (16 MB); it only spares work."""
    at = F.shiftrightunsigned("node", 64 - BITMAP_BITS)
    bits = nodes.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(node, {64 - BITMAP_BITS}) & 63 as int))").alias("bit"))
    got = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype="<i8")
    out[np.asarray(got["at"])] = np.asarray(got["bits"])
    return out.view(np.uint8)


def _candidate_sets(texts: DataFrame, bitmap) -> DataFrame:
    """``node`` and sorted shingles of the documents whose class may be a candidate, each class once a batch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                found: dict[int, bytes] = {}
                for own in _sets(_lower(batch["text"].slice(lo, 512)))[0]:
                    key = _class_key(own)
                    at = (key & ((1 << 64) - 1)) >> (64 - BITMAP_BITS)
                    if bitmap.value[at >> 3] >> (at & 7) & 1:
                        found[key] = own.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(emit, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal each class to the tile pairs it takes part in."""
    for batch in batches:
        members, node = np.asarray(batch["members"]), np.asarray(batch["node"]).view(np.uint64)
        tiles = -(-members // TILE)
        own = (mix(node) % tiles.astype(np.uint64)).astype(np.int64)
        row = np.repeat(np.arange(len(node)), tiles)
        other = np.arange(len(row)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        mine = own[row]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [*(batch[c].take(take) for c in ("node", "component", "weight", "signature", "shingles")), pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)), pa.array((mine > other).astype(np.int32))],
            names=["node", "component", "weight", "signature", "shingles", "i", "j", "side"],
        )


def similarity_groups(docs: DataFrame) -> DataFrame:
    """A row a document: ``doc_id``, ``mark`` (hash of the text), ``class_id`` (its group's smallest ``doc_id``), ``n_links`` (other
    documents at the threshold or above, copies among them) and ``class_size``."""
    spark = docs.sparkSession
    texts = documents(docs).withColumn("mark", F.xxhash64("text"))
    table = materialise(texts.mapInArrow(describe, "doc_id long, mark long, node long, size int, signature binary"), "signatures")
    place = F.coalesce("doc_id", F.lit(LAST))
    classes = materialise(table.where(F.col("size") > 0).groupBy("node").agg(F.first("signature").alias("signature"), F.count(F.lit(1)).alias("weight"), F.min(place).alias("least")), "classes")
    banded = materialise(classes.select("node", "signature").mapInArrow(buckets, "bucket long, node long"), "buckets")
    hubs = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "hub")
    stars = banded.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    candidates = materialise(connected_components(stars), "candidates")
    sized = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    dealt = sized.agg(F.sum(F.col("members") * F.ceil(F.col("members") / TILE))).first()[0] or 0  # a class goes to every tile pair of its row
    sets = _candidate_sets(texts.select("text"), spark.sparkContext.broadcast(_bitmap(candidates)))
    rows = candidates.join(sized, "component").join(classes.select("node", "signature", "weight"), "node").join(sets, "node")
    tiled = rows.mapInArrow(_tiles, "node long, component long, weight long, signature binary, shingles binary, i long, j long, side int")
    bins = parts_for(dealt, BIN_ROWS)
    own_bin = F.pmod(F.xxhash64("component", "i", "j"), F.lit(bins)).cast("int")
    links = materialise(tiled.withColumn("bin", own_bin).groupBy("bin").applyInArrow(thrifty(compare_bin), "node long, other long, links long"), "links")
    groups = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = classes.join(groups, "node", "left").join(counted, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"), "weight", "least")
    of_group = of_class.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("weight").alias("class_size"))
    known = of_class.join(of_group, "component").select("node", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "class_size")
    alone = F.col("size") == 0
    return table.join(known, "node", "left").select(
        "doc_id",
        "mark",
        F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("class_id") < LAST, F.col("class_id"))).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"),
    )


def report(docs: DataFrame) -> DataFrame:
    return similarity_groups(docs).select("doc_id", "class_id", "n_links", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, unchanged, that lead their group: one of each; repeats of a leader's row are dropped with the rest."""
    groups = similarity_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    lead = groups.select(F.col("doc_id").alias("id"), F.col("mark").alias("its")).distinct()
    rows = boxed(docs).withColumn("mark", F.xxhash64("text"))
    joined = rows.join(lead, rows["doc_id"].eqNullSafe(lead["id"]) & (rows["mark"] == lead["its"]))
    return joined.dropDuplicates(["id", "its"]).select(*[field(c) for c in docs.columns])
