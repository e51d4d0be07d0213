"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has COORDINATES bins. Rounds of hashing place every shingle of a document into one bin a round, each bin keeping the least
(round, hash); a document leaves the rounds once its bins are full, and round COORDINATES + j puts every shingle into bin j, so no bin
stays empty. Equal bins of two sketches are concentrated about the Jaccard similarity as independent MinHash values would be, at a
cost near the number of shingles instead of their product with the bins.

Documents with equal shingle sets are one class (a 128-bit digest of the set), and classes are compared, copies are not. BANDS bands of
ROWS bins propose candidates; every class of a bucket is hung on the bucket's smallest, so candidates are stars and never all pairs.
A connected piece of candidates is cut into tiles of about TILE classes or TILE_SHINGLES, and up to DIRECT_TILES of them all meet. A
larger piece goes through two steps: each class is verified against the heads of its buckets, in blocks, which joins groups of near
copies at a linear cost; then classes of different components meet, tile by tile, within each bucket that still holds several, or
within the piece where that sends fewer rows. Everywhere a pair is compared exactly, on its full sets, if it shares a band, its sizes
allow the threshold and it isn't known to be joined. With the defaults a pair at the threshold
shares no band with probability (1 - 0.85**5)**30, below 3e-8; every pair that shares one is decided exactly.

Defined results: words are runs of non-blanks with A to Z lower-cased; one to four words are one shingle; null, empty and blank texts have
none and link with nothing; a null ``doc_id`` ranks last and its own component is null if it stands alone; repeated rows are copies; a
very long text is hashed whole, and tasks are dealt by the size of the sets; an empty table gives an empty table; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import documents, materialise, parts_for
from threadloom.llm.hashing import BASE, mix
from threadloom.llm.near_join import LAST, shingles
from threadloom.llm.near_join import _overlaps as overlaps
from threadloom.plans.fixpoint import connected_components

#: Similarity of a link, in hundredths.
THRESHOLD = 85
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
#: Classes of a tile, and tiles of a piece up to which they all meet directly.
TILE, DIRECT_TILES = 256, 16
#: Shingles (8 bytes each) of a tile, and of the groups that a task gets at a time, about.
TILE_SHINGLES, TASK_SHINGLES = 1 << 20, 1 << 21
#: Bytes of text that a step turns into shingles.
STEP_BYTES = 1 << 20
BITMAP_BITS = 27
_ROUNDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(13))
_BAND = mix(np.arange(1, ROWS + 1, dtype=np.uint64) + np.uint64(29))


def sketches(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches (texts x bins) of shingle keys in text order; texts without shingles have all ones. Repeated keys change nothing."""
    out = np.full((len(sizes), COORDINATES), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat, text = out.reshape(-1), np.repeat(np.arange(len(sizes)), sizes)
    for k in range(2 * COORDINATES):
        if not len(keys):
            break
        h = mix(keys ^ _ROUNDS[k])
        place = ((h >> np.uint64(32)) * np.uint64(COORDINATES) >> np.uint64(32)).astype(np.int64) if k < COORDINATES else k - COORDINATES
        np.minimum.at(flat, text * COORDINATES + place, (h & np.uint64(0xFFFFFFFF)) | np.uint64(k << 32))
        missing = (out == np.iinfo(np.uint64).max).any(axis=1)[text]  # a later round never replaces an earlier one
        keys, text = keys[missing], text[missing]
    return out


def band_keys(signs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch; the band's number goes in, so bands never meet each other."""
    folded = (mix(signs.reshape(-1, BANDS, ROWS) + np.uint64(BASE)) * _BAND).sum(axis=2, dtype=np.uint64)
    return mix(folded + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def _own_sets(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle keys, all keys with repeats, and their numbers."""
    keys, sizes = shingles(texts)
    ends = np.cumsum(sizes)
    return [np.unique(keys[a:b]) for a, b in zip(ends - sizes, ends, strict=True)], keys, sizes


def digest(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    halves = [mix(mix(own + np.uint64(salt)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))) for salt in (BASE, 0xA24BAED4963EE407)]
    return np.concatenate(halves).tobytes()


def _mark(node: bytes) -> int:
    return int.from_bytes(node[:8], "little") >> (64 - BITMAP_BITS)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in steps of about STEP_BYTES, A to Z lower-cased; a longer text is a step of its own."""
    lo, held, own = 0, 0, []
    for i, text in enumerate(batch["text"]):
        own.append(text.as_py().encode().lower())
        held += len(own[-1])
        if held >= STEP_BYTES:
            yield lo, own
            lo, held, own = i + 1, 0, []
    if own:
        yield lo, own


DESCRIBED = "doc_id long, node binary, size long, bands array<long>"


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, texts in _steps(batch):
            own, keys, sizes = _own_sets(texts)
            bands = band_keys(sketches(keys, sizes))
            some = sizes > 0
            node = pa.array([digest(x) if s else None for x, s in zip(own, some, strict=True)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, len(own)), node, pa.array([len(x) for x in own], pa.int64()), lists], names=["doc_id", "node", "size", "bands"])


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """The classes as a bitmap of fixed size (16 MB): it spares work, and decides nothing."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([_mark(x) for x in batch["node"].to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["at", "bit"])

    got = nodes.select("node").mapInArrow(emit, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**(BITMAP_BITS - 6) rows at most
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype="<i8")
    out[np.asarray(got["at"])] = np.asarray(got["bits"])
    return out.view(np.uint8)


def candidate_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``shingles`` (sorted keys) of the given classes, one row each, from a second reading of the texts."""
    held = texts.sparkSession.sparkContext.broadcast(_bitmap(nodes))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _steps(batch):
                found: dict[bytes, bytes] = {}
                for own in _own_sets(texts)[0]:
                    if len(own):
                        node = digest(own)
                        at = _mark(node)
                        if held.value[at >> 3] >> (at & 7) & 1:
                            found[node] = own.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["node", "shingles"])

    return texts.select("text").mapInArrow(emit, "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def forest(sets: list[np.ndarray], bands: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, bucket: int | None = None) -> list[tuple[int, int]]:
    """Edges that join what the links between ``left`` and ``right`` (rows; all pairs of one if they are the same) join.

    A pair is verified if it shares a band, its sizes allow a link and its labels differ; with a ``bucket``, only if that is the first
    band the two share, as each of their buckets sees the pair.
    """
    sizes = np.array([len(x) for x in sets])
    small, large = np.minimum.outer(sizes[left], sizes[right]), np.maximum.outer(sizes[left], sizes[right])
    met = np.zeros(small.shape, dtype=bool)
    chosen = met.copy()
    for k in range(BANDS):
        equal = bands[left, k][:, None] == bands[right, k][None, :]
        chosen |= equal if bucket is None else equal & ~met & (bands[left, k] == bucket)[:, None]
        met |= equal
    chosen &= (100 * small >= THRESHOLD * large) & (label[left][:, None] != label[right][None, :])
    if left is right:
        chosen = np.triu(chosen, 1)
    pairs = np.argwhere(chosen)
    if not len(pairs):
        return []
    both = overlaps([sets[i] for i in left], [sets[j] for j in right], pairs)
    a, b = left[pairs[:, 0]], right[pairs[:, 1]]
    linked = 100 * both >= THRESHOLD * (sizes[a] + sizes[b] - both)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
        p, q = find(int(label[x])), find(int(label[y]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


LINKS = "a binary, b binary"


def no_bucket() -> Column:
    return F.lit(None).cast("long").alias("bucket")


def confirm(table: pa.Table) -> pa.Table:
    """The forests of all groups (``part``) of a task's share: rows of side 0 meet those of side 1, or each other where there is no side 1."""
    part, side, bucket = np.asarray(table["part"]), np.asarray(table["side"]), table["bucket"].to_pylist()
    node, named = table["node"].to_pylist(), table["label"].to_pylist()
    bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(len(node), BANDS)
    code: dict[bytes, int] = {}
    label = np.array([code.setdefault(x, len(code)) for x in named], dtype=np.int64)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table["shingles"].to_pylist()]
    order = np.lexsort((side, part))
    heads = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(order) else []
    found: list[tuple[int, int]] = []
    for lo, hi in zip(heads, np.r_[heads[1:], len(order)], strict=True):
        rows = order[lo:hi]
        left, right = rows[side[rows] == 0], rows[side[rows] == 1]
        found += forest(sets, bands, label, left, right if len(right) else left, bucket[rows[0]])
    return pa.table({"a": pa.array([node[a] for a, _ in found], pa.binary()), "b": pa.array([node[b] for _, b in found], pa.binary())})


def confirmed(rows: DataFrame, known: DataFrame, group: list[str]) -> DataFrame:
    """Confirmed edges (``a``, ``b``) of rows ``node``, ``label``, ``side``, ``bucket`` (or null) and the columns that name a group; ``known`` has the classes' sets.

    Groups are dealt to tasks by a hash, each task getting about TASK_SHINGLES.
    """
    dealt = rows.join(known.select("node", "size"), "node").agg(F.sum("size")).first()[0] or 0
    part = F.xxhash64(*group)
    full = rows.join(known, "node").select("node", "label", "side", "bucket", "bands", "shingles", part.alias("part"))
    return full.withColumn("bin", F.pmod("part", F.lit(parts_for(dealt, TASK_SHINGLES)))).groupBy("bin").applyInArrow(confirm, LINKS)


def tiles(n: Column, shingle_count: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / TILE), F.ceil(shingle_count / TILE_SHINGLES)).cast("int")


def own_tile(parts: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")


def _seat(kind: int, i: Column, j: Column, side: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))


def tile_pairs(kind: int, parts: str) -> Column:
    """The pairs of tiles that a class of ``tile`` takes part in, each tile with itself and every other."""
    return F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda k: _seat(kind, F.least("tile", k), F.greatest("tile", k), F.when(F.col("tile") > k, 1).otherwise(0)))


def _directly(members: DataFrame, known: DataFrame) -> DataFrame:
    """Edges within pieces of ``parts`` tiles, every tile against every other."""
    own = members.withColumn("tile", own_tile("parts"))
    dealt = own.select("node", "component", F.explode(tile_pairs(0, "parts")).alias("at")).select("node", F.col("node").alias("label"), no_bucket(), "component", "at.*")
    return confirmed(dealt, known, ["component", "i", "j"])


def _heads(members: DataFrame, banded: DataFrame, known: DataFrame) -> DataFrame:
    """Edges between classes of giant pieces and the heads of their buckets. A head meets its classes in blocks, one copy of it each."""
    pairs = banded.join(members.select("node"), "node", "left_semi").where("node <> hub").select("node", "hub").distinct().join(known.select("node", "size"), "node")
    pairs = materialise(pairs, "head-pairs")
    blocks = pairs.groupBy("hub").agg(tiles(F.count(F.lit(1)), F.sum("size")).alias("blocks"))
    own = pairs.join(blocks, "hub").select("node", "hub", own_tile("blocks").alias("block"), F.lit(1).alias("side"))
    head = blocks.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"))
    return confirmed(own.unionByName(head).select("*", F.col("node").alias("label"), no_bucket()), known, ["hub", "block"])


def _across(members: DataFrame, known: DataFrame, label: DataFrame) -> DataFrame:
    """Edges between classes of different components within one bucket, or within one piece where that sends fewer rows.

    The largest component of such a group is tiled apart from the rest, and its tiles never meet each other, so its classes are sent
    once for each tile of the rest.
    """
    base = materialise(members.select("node", "component").join(label, "node").join(known.select("node", "size", "bands"), "node"), "labelled")
    sent = lambda: F.count(F.lit(1)) * tiles(F.count(F.lit(1)), F.sum("size"))
    by_bucket = base.select("component", "size", F.explode("bands").alias("bucket")).groupBy("component", "bucket").agg(F.when(F.count(F.lit(1)) > 1, sent()).alias("rows")).groupBy("component").agg(F.sum("rows").alias("apart"))
    whole = base.groupBy("component").agg(sent().alias("rows")).join(by_bucket, "component").select("component", (F.col("rows") <= F.coalesce("apart", F.lit(0))).alias("whole"))
    placed = base.join(whole, "component")
    rows = placed.where("whole").select("node", "label", "size", "whole", F.xxhash64("component").alias("place"))
    rows = rows.unionByName(placed.where("not whole").select("node", "label", "size", "whole", F.explode("bands").alias("place")))
    by_label = rows.groupBy("whole", "place", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    mixed = by_label.groupBy("whole", "place").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label", "s")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("labels > 1")
    mixed = mixed.select("whole", "place", F.col("main.label").alias("main"), tiles(F.col("main.n"), F.col("main.s")).alias("wide"), tiles(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("rest"))
    is_main = F.col("label") == F.col("main")
    own = rows.join(mixed, ["whole", "place"]).withColumn("tile", F.when(is_main, own_tile("wide")).otherwise(own_tile("rest")))
    against_rest = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda j: _seat(0, F.col("tile"), j, F.lit(0)))
    against_main = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda i: _seat(0, i, F.col("tile"), F.lit(1)))
    seats = F.when(is_main, against_rest).otherwise(F.concat(against_main, tile_pairs(1, "rest")))
    dealt = own.select("node", "label", "whole", "place", F.explode(seats).alias("at")).select("node", "label", F.when(~F.col("whole"), F.col("place")).alias("bucket"), "whole", "place", "at.*")
    return confirmed(dealt, known, ["whole", "place", "kind", "i", "j"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row a document: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest ``doc_id`` that links reach)."""
    texts = documents(docs)
    table = materialise(texts.mapInArrow(describe, DESCRIBED), "sketches")
    classes = materialise(
        table.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.first("size").alias("size"), F.min(F.coalesce("doc_id", F.lit(LAST))).alias("least")), "classes"
    )
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "hub")
    banded = materialise(banded.join(hubs, "bucket"), "buckets")
    stars = banded.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    pieces = materialise(connected_components(stars).join(classes.select("node", "size"), "node"), "pieces")
    known = materialise(pieces.select("node").join(classes.select("node", "bands", "size"), "node").join(candidate_sets(texts, pieces), "node"), "sets")
    sized = pieces.groupBy("component").agg(tiles(F.count(F.lit(1)), F.sum("size")).alias("parts"))
    members = pieces.select("node", "component").join(sized, "component")
    edges = materialise(_directly(members.where(F.col("parts") <= DIRECT_TILES), known), "edges")
    giant = materialise(members.where(F.col("parts") > DIRECT_TILES), "giant")
    if not giant.isEmpty():
        first = materialise(_heads(giant, banded, known), "edges")
        so_far = connected_components(first).select("node", F.col("component").alias("label"))
        label = giant.select("node").join(so_far, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        edges = edges.unionByName(first).unionByName(materialise(_across(giant, known, label), "edges"))
    groups = connected_components(edges)
    of_class = materialise(classes.select("node", "least").join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "groups")
    of_group = of_class.groupBy("component").agg(F.min("least").alias("first"))
    led = of_class.join(of_group, "component").select("node", F.when(F.col("first") < LAST, F.col("first")).alias("component_id"))
    linked = table.where("node is not null").join(led, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return linked.unionByName(table.where("node is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
