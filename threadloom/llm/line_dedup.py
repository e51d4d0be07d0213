"""Line dedup: an exact set-similarity join over lines.

A line is its set of words. All words of the corpus are counted into a table of fixed size, which gives every word one place in a
global order from rare to common (equal counts by hash). Two lines with Jaccard at least THRESHOLD share a word among the first
``n - ceil(THRESHOLD * n) + 1`` of each in that order, so prefix words meet in tasks by hash; a word that occurs once can't be shared
and sends no row. At the meeting the length filter, the positional filter (words left after the shared one must suffice) and a parity
bitmap (which bounds the symmetric difference from below) leave candidates, and these are verified on the words themselves. A line
goes if an earlier line, by (doc_id, line number), matches it; lines are judged on the input, not on what is left.

Lines with equal sets collapse before they meet: within a leaf (one batch of documents), then over the leaves, and the verdict goes
down the same way, so a line that a third of all documents hold is one row a leaf. Each line proposes only its earliest candidates per
prefix word first; a line that none of them settles, though more were there, proposes all in a second round. A prefix word with more
than SPLIT_ROWS rows is cut into blocks of that many, which meet pairwise; the list of such words is a table.

Defined results: blank lines stay; a null or empty text has none; a very long text is taken in parts of 60,000 lines; lines of one to
three words match equal sets only (nothing else reaches 0.8); of equal places (repeated rows) all lines stay or go together; a null
``doc_id`` comes last; rows that repeat a ``doc_id`` are one document as to order; an empty table gives an empty table; other columns,
whatever their names, are ignored by the report and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import boxed, documents, field, forget, give_back, materialise, parts_for
from threadloom.llm.hashing import BASE, distinct, line_words, mix

THRESHOLD = 0.8
#: log2 of the rarity table's size: 4 MB on the driver and in each worker, whatever the corpus.
RARITY_BITS = 22
BLOCK_BITS = 16
#: Partial word counts merged at once.
MERGE_BITS = 6
BITMAP_BITS = 27
#: Bits of the parity bitmap that candidate pairs are held to before their words meet.
SKETCH = 512
#: Candidates a line proposes per prefix word in the first round.
FIRST = 2
#: Prefix rows that meet in one task, about.
TASK_ROWS = 400_000
#: Prefix rows that a task gathers before it deals them to buckets.
DEAL_ROWS = 250_000
#: Prefix rows of one word that meet in one block.
SPLIT_ROWS = 50_000
#: Prefix words that are joined by broadcast when they are to be split; more of them join by shuffle.
HOT_BOUND = 100_000
#: Lines of a leaf, about.
LEAF_LINES = 250_000
LAST = (1 << 63) - 1
#: Texts, and bytes of text, that are hashed at once; one longer text is taken alone.
STEP, STEP_BYTES = 512, 1 << 20
_SALT = 0xD1B54A32D192ED03
_TOKEN_BITS = 42
_TOKEN_MASK = np.uint64((1 << _TOKEN_BITS) - 1)


class Lines:
    """The non-blank lines of some texts as sorted sets: word keys of a line lie together, ordered from rare to common if ``rarity`` is given."""

    def __init__(self, texts: list[bytes], rarity: np.ndarray | None = None, count: np.ndarray | None = None):
        if count is None:
            count = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
        keys, line = line_words(texts)
        first = np.cumsum(count) - count
        if count.sum() >= 1 << 16:
            raise ValueError("too many lines at once")
        packed = line.view(np.uint64) << np.uint64(48)
        packed |= keys >> np.uint64(64 - _TOKEN_BITS)
        if rarity is not None:
            packed |= rarity[keys >> np.uint64(64 - RARITY_BITS)].astype(np.uint64) << np.uint64(_TOKEN_BITS)
        packed = distinct(packed)
        line = (packed >> np.uint64(48)).astype(np.int64)
        self.token = packed & _TOKEN_MASK
        self.rank = (packed >> np.uint64(_TOKEN_BITS)).astype(np.uint8) & np.uint8(63)
        self.start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.start, len(packed)])
        line = line[self.start]
        self.text = np.searchsorted(first, line, side="right") - 1
        self.number = line - first[self.text]
        spread = mix(self.token + np.uint64(BASE))
        total = lambda x: np.add.reduceat(x, self.start) if len(packed) else np.zeros(0, np.uint64)
        self.node = mix(total(spread) + self.size.astype(np.uint64)).view(np.int64)
        self.check = (mix(total(spread * spread + np.uint64(_SALT))) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        self.spread = spread

    def bits(self) -> np.ndarray:
        """Parity bitmaps: bit b is the parity of the line's words with hash b."""
        return np.bitwise_xor.reduceat(np.uint64(1) << (self.spread & np.uint64(63)), self.start)

    def sketches(self) -> list[bytes]:
        """Parity bitmaps of SKETCH bits."""
        bit = ((self.spread >> np.uint64(8)) % np.uint64(SKETCH)).astype(np.int64)
        out = []
        for lo in range(0, len(self.start), 4096):
            size = self.size[lo : lo + 4096]
            row = np.repeat(np.arange(len(size)), size)
            own = bit[self.start[lo] : self.start[lo] + int(size.sum())]
            odd = (np.bincount(row * SKETCH + own, minlength=len(size) * SKETCH) & 1).astype(np.uint8)
            packed = np.packbits(odd.reshape(-1, SKETCH), axis=1)
            out += [r.tobytes() for r in packed]
        return out

    def firsts(self, doc: np.ndarray) -> np.ndarray:
        """Indices of the lines of which none earlier, by ``doc`` and number, has the same set."""
        order = np.lexsort((self.number, doc, self.check, self.node))
        return order[np.r_[True, (np.diff(self.node[order]) != 0) | (np.diff(self.check[order]) != 0)]] if len(order) else order


def line_batches(batch: pa.RecordBatch, rarity: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    """Lines of a batch, a few texts at a time: never over 2**16 - 1 lines, but for one text that has more (cut into parts by lines)."""
    lo = 0
    while lo < batch.num_rows:
        part = batch.slice(lo, STEP)
        texts = part["text"].cast(pa.binary()).to_pylist()
        count = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
        total = np.cumsum(count)
        take = max(1, min(int(np.searchsorted(total, 60_000, side="right")), int(np.searchsorted(np.cumsum([len(t) for t in texts]), STEP_BYTES, side="right"))))
        if take == 1 and total[0] > 60_000:
            pieces = texts[0].split(b"\n")
            for at in range(0, len(pieces), 60_000):
                lines = Lines([b"\n".join(pieces[at : at + 60_000])], rarity)
                lines.number = lines.number + at
                yield part.slice(0, 1), lines
        else:
            yield part.slice(0, take), Lines(texts[:take], rarity, count[:take])
        lo += take


def prefix_widths(size: np.ndarray) -> np.ndarray:
    """Prefix words of lines of some sizes; up to three words, only equal sets match."""
    return np.where(size > 3, size - np.ceil(THRESHOLD * size - 1e-9).astype(np.int64) + 1, 0)


def _order(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch["doc_id"].fill_null(LAST))


#: A row a line: ``n`` is the number of the leaf's lines with its set on the earliest of them, else 0. A row with line -1 has word counts:
#: ``leaf`` is the partition, ``node`` the block of the rarity table; one with line -2 has in ``mark`` the number of prefix words to come.
FACTS = "leaf long, node long, check int, doc_id long, mark long, line int, n int, places binary, counts binary"


def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line rows, leaf by leaf, and at the end of a partition its word counts, each line of a step counted once."""
    from pyspark import TaskContext

    forget()
    part = TaskContext.get().partitionId()
    count = np.zeros(1 << RARITY_BITS, dtype=np.uint32)
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in FACTS.split(", ")])
    held: list[tuple[np.ndarray, ...]] = []
    leaf, rows, prefixes = part << 32, 0, 0

    def flush() -> pa.RecordBatch:
        node, check, doc, null, mark, line = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((line, doc, check, node))
        node, check, doc, null, mark, line = (x[order] for x in (node, check, doc, null, mark, line))
        head = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (check[1:] != check[:-1])])
        n = np.zeros(len(node), dtype=np.int32)
        n[head] = np.diff(np.r_[head, len(node)])
        blank = pa.nulls(len(node), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(node), leaf)), pa.array(node), pa.array(check), pa.array(doc, mask=null), pa.array(mark), pa.array(line), pa.array(n), blank, blank], schema=schema)

    for batch in batches:
        for own, lines in line_batches(batch):
            doc, null = _order(own), np.asarray(own["doc_id"].is_null())
            once = lines.firsts(doc[lines.text])
            prefixes += int(prefix_widths(lines.size[once]).sum())
            word = np.repeat(np.arange(len(once)), lines.size[once])
            at = lines.start[once][word] + np.arange(len(word)) - (np.cumsum(lines.size[once]) - lines.size[once])[word]
            np.add.at(count, (lines.token[at] >> np.uint64(_TOKEN_BITS - RARITY_BITS)).astype(np.int64), np.uint32(1))
            held.append((lines.node, lines.check, doc[lines.text], null[lines.text], np.asarray(own["mark"])[lines.text], lines.number.astype(np.int32)))
            rows += len(lines.node)
            if rows >= LEAF_LINES:
                yield flush()
                held, leaf, rows = [], leaf + 1, 0
    if rows:
        yield flush()
    yield pa.RecordBatch.from_pylist([{"leaf": part, "line": -2, "mark": prefixes}], schema=schema)
    for block, counts in enumerate(count.reshape(-1, 1 << BLOCK_BITS)):
        used = np.flatnonzero(counts)
        if len(used):
            row = {"leaf": part, "node": block, "line": -1, "places": used.astype("<u2").tobytes(), "counts": counts[used].astype("<u4").tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=schema)


def _counts(table: pa.Table) -> np.ndarray:
    total = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
    for places, counts in zip(table["places"].to_pylist(), table["counts"].to_pylist(), strict=True):
        total[np.frombuffer(places, dtype="<u2")] += np.frombuffer(counts, dtype="<u4")
    return np.minimum(total, (1 << 32) - 1)


def merge_counts(key: tuple, table: pa.Table) -> pa.Table:
    total = _counts(table)
    used = np.flatnonzero(total)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "places": pa.array([used.astype("<u2").tobytes()], pa.binary()), "counts": pa.array([total[used].astype("<u4").tobytes()], pa.binary())})


def block_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Six-bit ranks of a block's counts, rare first: halves of powers of two, so ranks are monotone in the counts, and 0 is one at most."""
    for batch in batches:
        for row in batch.to_pylist():
            total = _counts(pa.Table.from_pylist([row]))
            rank = np.minimum(63, np.floor(2 * np.log2(np.maximum(1, total)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([rank.tobytes()], pa.binary())], names=["block", "ranks"])


def rarity_ranks(table: DataFrame) -> np.ndarray:
    """The rarity table: partial counts merge in rounds of 64, so no task holds more than that many of one block."""
    level = table.where("line = -1").select(F.col("node").alias("block"), F.col("leaf").alias("part"), "places", "counts")
    parts = level.agg(F.max("part")).first()[0] or 0
    while True:
        merged = level.withColumn("part", F.shiftright("part", MERGE_BITS))
        level = merged.groupBy("block", "part").applyInArrow(merge_counts, "block long, part long, places binary, counts binary")
        parts >>= MERGE_BITS
        if not parts:
            break
    got = level.mapInArrow(block_ranks, "block long, ranks binary").toArrow()  # 2 ** RARITY_BITS bytes
    rank = np.zeros((1 << (RARITY_BITS - BLOCK_BITS), 1 << BLOCK_BITS), dtype=np.uint8)
    for block, own in zip(got["block"].to_pylist(), got["ranks"].to_pylist(), strict=True):
        rank[block] = np.frombuffer(own, dtype=np.uint8)
    return rank.ravel()


#: A prefix row: the word where lines meet (with its bucket), the line's set, its parity bitmap and place, its words and the word's place
#: among them (at most 65,535, which only weakens a filter).
RECORD = np.dtype([("meet", "<u4"), ("node", "<i8"), ("bits", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("size", "<i4"), ("place", "<u2")])
#: The same, unpacked: ``own`` tells the blocks of a split word's rows apart; its lowest bit says that a block meets itself.
MEETING = "meet long, node long, bits long, doc long, line int, size int, place int, own int"
#: Bucket of the words that may have more than SPLIT_ROWS rows.
COMMON = -1


def _dealt(rows: np.ndarray, common: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Prefix rows as one run of bytes a bucket: the engine then moves runs, not rows."""
    bucket = np.where(common, COMMON, (mix(rows["meet"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64))
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    offsets = (np.r_[head, len(bucket)] * RECORD.itemsize).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(rows[order].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[head].astype(np.int32)), runs], names=["bucket", "rows"])


def _records(batch: pa.RecordBatch, keep: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Columns of MEETING from runs, for the meetings of the bitmap ``keep`` alone if there is one; words are hashed to 32 bits in their
    bucket, and a chance meeting only costs a comparison."""
    runs = batch["rows"].to_pylist()
    rows = np.frombuffer(b"".join(runs), dtype=RECORD)
    bucket = np.repeat(np.asarray(batch["bucket"]).astype(np.int64), [len(r) // RECORD.itemsize for r in runs])
    meet = mix((bucket.view(np.uint64) << np.uint64(32)) | rows["meet"]).view(np.int64)
    if keep is not None:
        ok = np.flatnonzero(_in_bitmap(meet, keep))
        rows, meet = rows[ok], meet[ok]
    wide = {c: np.ascontiguousarray(rows[c]) for c in ("node", "doc", "line", "size")}
    return {"meet": meet, "node": wide["node"], "bits": np.ascontiguousarray(rows["bits"]).view(np.int64), "doc": wide["doc"], "line": wide["line"], "size": wide["size"], "place": rows["place"].astype(np.int32), "own": np.ones(len(rows), np.int32)}


def prefix_rows(texts: DataFrame, rarity, buckets: int) -> DataFrame:
    """A row for each prefix word, of those that occur twice, of each distinct line of a step, dealt to buckets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        usual: list[np.ndarray] = []
        for batch in batches:
            for part, lines in line_batches(batch, rarity.value):
                doc = _order(part)[lines.text]
                pick = lines.firsts(doc)
                size, bits = lines.size[pick], lines.bits()[pick] if len(pick) else np.zeros(0, np.uint64)
                width = prefix_widths(size)
                at = np.repeat(np.arange(len(pick)), width)
                place = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
                word = lines.start[pick][at] + place
                ok = lines.rank[word] > 0
                at, place, word = at[ok], place[ok], word[ok]
                rows = np.zeros(len(at), dtype=RECORD)
                rows["meet"] = mix(lines.token[word] * np.uint64(3)) >> np.uint64(32)
                rows["node"], rows["bits"], rows["doc"], rows["line"] = lines.node[pick][at], bits[at], doc[pick][at], lines.number[pick][at]
                rows["size"], rows["place"] = size[at], np.minimum(place, 65535)
                held.append(rows)
                usual.append(np.exp2((lines.rank[word] + 1) / 2) > SPLIT_ROWS)
                if sum(map(len, held)) >= DEAL_ROWS:
                    yield _dealt(np.concatenate(held), np.concatenate(usual), buckets)
                    held, usual = [], []
        if sum(map(len, held)):
            yield _dealt(np.concatenate(held), np.concatenate(usual), buckets)

    return texts.mapInArrow(emit, "bucket int, rows binary")


def unpacked(runs: DataFrame, keep=None) -> DataFrame:
    """Prefix rows one by one; ``keep`` is a bitmap of meetings wanted."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _records(batch, None if keep is None else keep.value)
            for lo in range(0, len(rows["meet"]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000]) for c in rows.values()], names=list(rows))

    return runs.mapInArrow(emit, MEETING)


def common_meetings(rows: Callable[..., DataFrame]) -> tuple[DataFrame, int]:
    """Rows of common words at the blocks where they meet, and how many there are; ``rows(keep)`` unpacks them, those of a bitmap of
    meetings alone if there is one.

    A word with more than SPLIT_ROWS rows first keeps each distinct line once, at its earliest place (copies of a line are no pairs),
    and what still has more is cut into blocks of about SPLIT_ROWS.
    """
    whole = rows()
    counted = whole.groupBy("meet").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counted.groupBy(F.when(F.col("n") > SPLIT_ROWS, F.col("meet")).alias("meet")).agg(F.sum("n").alias("n")), "split-words")  # the others in one row
    hot = counts.where("meet is not null").select("meet")
    total, copies, many = counts.agg(F.sum("n"), F.sum(F.when(F.col("meet").isNotNull(), F.col("n"))), F.count("meet")).first()
    if not many:
        return whole, total or 0
    side = F.broadcast(hot) if many <= HOT_BOUND else hot
    keep = whole.sparkSession.sparkContext.broadcast(_bitmap(hot, "meet"))
    others = [c for c in whole.columns if c not in ("meet", "node", "doc", "line")]
    earliest = rows(keep).join(side, "meet", "left_semi").groupBy("meet", "node").agg(F.min(F.struct("doc", "line", *others)).alias("at")).select("meet", "node", "at.*").select(*whole.columns)
    once = materialise(earliest, "split-rows")
    ways = materialise(once.groupBy("meet").agg(F.ceil(F.count(F.lit(1)) / SPLIT_ROWS).alias("ways"), F.count(F.lit(1)).alias("n")), "split-words")
    sent = ways.agg(F.sum(F.col("ways") * F.col("n"))).first()[0]
    joined = once.join(F.broadcast(ways.select("meet", "ways")) if many <= HOT_BOUND else ways.select("meet", "ways"), "meet")
    mine = joined.withColumn("mine", F.pmod(F.xxhash64("node"), "ways")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)))
    block = F.xxhash64("meet", F.least("mine", "other"), F.greatest("mine", "other"))
    own = (F.col("mine") * 2 + (F.col("mine") == F.col("other")).cast("int")).cast("int")
    split = mine.withColumn("at", block).select(F.col("at").alias("meet"), *[c for c in whole.columns if c not in ("meet", "own")], own.alias("own"))
    return whole.join(side, "meet", "left_anti").unionByName(split), total - copies + sent


PAIRS = "later long, later_doc long, later_line int, earlier long, earlier_doc long, earlier_line int, more boolean, meet long"


def propose(rows: dict[str, np.ndarray], limit: int, only: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (later, earlier) of one task's prefix rows; ``more`` marks a later line with candidates beyond the limit."""
    meet, node, _, doc, line = list(rows.values())[:5]
    if not len(meet):
        return
    order = np.lexsort((line, doc, node, meet))
    order = order[np.r_[True, (np.diff(meet[order]) != 0) | (np.diff(node[order]) != 0)]]  # a line's earliest row stands for it
    order = order[np.lexsort((node[order], line[order], doc[order], meet[order]))]
    meet, node, bits, doc, line, size, place, own = (x[order] for x in rows.values())
    bits = bits.view(np.uint64)
    head = np.flatnonzero(np.r_[True, meet[1:] != meet[:-1]])
    start = np.repeat(head, np.diff(np.r_[head, len(meet)]))
    active = np.flatnonzero(np.arange(len(meet)) > start)
    if only is not None:
        active = active[_in_bitmap(node[active], only)]
    at, n, left = start[active], size[active], (size - place)[active]
    made = np.zeros(len(meet), dtype=np.int64)
    later, earlier, more = [], [], []
    while len(active):
        # ever fewer pairs go through ever dearer filters: length, places, parity, order
        m = size[at]
        some = np.flatnonzero((5 * n >= 4 * m) & (5 * m >= 4 * n))
        x, m = at[some], m[some]
        both = n[some] + m
        need = np.ceil(both * (THRESHOLD / (1 + THRESHOLD)) - 1e-9).astype(np.int64)
        ok = np.flatnonzero(np.minimum(left[some], m - place[x]) >= need)
        some, x, spare = some[ok], x[ok], (both - 2 * need)[ok]
        y = active[some]
        ok = np.bitwise_count(bits[y] ^ bits[x]) <= spare
        ok &= (node[y] != node[x]) & ((own[y] != own[x]) | (own[y] & 1 == 1))
        ok &= (doc[x] < doc[y]) | ((doc[x] == doc[y]) & (line[x] < line[y]))
        hit = y[ok]
        later.append(hit)
        earlier.append(x[ok])
        more.append(made[hit] >= limit)
        made[hit] += 1
        at += 1
        on = (at < active) & (made[active] <= limit)
        if not on.all():
            active, at, n, left = active[on], at[on], n[on], left[on]
    if not later:
        return
    later, earlier, more = np.concatenate(later), np.concatenate(earlier), np.concatenate(more)
    pair = np.lexsort((node[earlier], node[later]))
    fresh = np.r_[True, (np.diff(node[later][pair]) != 0) | (np.diff(node[earlier][pair]) != 0)] if len(pair) else np.zeros(0, bool)
    once = pair[fresh | more[pair]]
    a, b = later[once], earlier[once]
    columns = [node[a], doc[a], line[a], node[b], doc[b], line[b], more[once], meet[a]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in PAIRS.split(", ")])


def propose_runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """``propose`` on a task's runs; a task may hold several buckets, and takes all of them at once."""
    held = [_records(b) for b in batches]
    if held:
        yield from propose({c: np.concatenate([h[c] for h in held]) for c in held[0]}, limit)
    held.clear()
    give_back()


def propose_rows(batches: Iterator[pa.RecordBatch], limit: int, only: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if parts:
        table = pa.concat_tables(parts)
        yield from propose({c.split()[0]: np.asarray(table[c.split()[0]]) for c in MEETING.split(", ")}, limit, only)
        del table
    parts.clear()
    give_back()


def _in_bitmap(nodes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = (nodes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bitmap(nodes: DataFrame, name: str) -> np.ndarray:
    """Nodes as a bitmap of fixed size (16 MB); it only spares work."""
    shift = 64 - BITMAP_BITS
    bits = nodes.select(F.shiftright(F.shiftrightunsigned(name, shift), 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {shift}) & 63 as int))").alias("bit"))
    got = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype="<i8")
    out[np.asarray(got["at"])] = np.asarray(got["bits"])
    return out.view(np.uint8)


def _place_key(doc, line):
    """The document's id and the line number in one key, in numpy; ``_place`` is the same in SQL."""
    return doc * 1_000_003 + line


def wanted_lines(texts: DataFrame, bitmap) -> DataFrame:
    """``node``, ``check``, number of words, a parity bitmap of SKETCH bits and the words, for the lines whose place the bitmap passes;
    only those lines are hashed."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                pieces = [t.split(b"\n") for t in part["text"].cast(pa.binary()).to_pylist()]
                many = np.array([len(x) for x in pieces], dtype=np.int64)
                text = np.repeat(np.arange(len(pieces)), many)
                line = np.arange(len(text)) - (np.cumsum(many) - many)[text]
                with np.errstate(over="ignore"):
                    key = mix(_place_key(_order(part)[text], line).view(np.uint64)).view(np.int64)
                ok = np.flatnonzero(_in_bitmap(key, bitmap.value))
                for at in range(0, len(ok), 60_000):
                    chosen = [pieces[i][j] for i, j in zip(text[ok[at : at + 60_000]].tolist(), line[ok[at : at + 60_000]].tolist(), strict=True)]
                    lines = Lines(chosen)
                    columns = [pa.array(lines.node), pa.array(lines.check), pa.array(lines.size.astype(np.int32)), pa.array(lines.sketches(), pa.binary()), pa.array([chosen[i] for i in lines.text.tolist()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "check", "size", "sketch", "words"])

    found = texts.mapInArrow(emit, "node long, check int, size int, sketch binary, words binary")
    return found.groupBy("node", "check").agg(*[F.first(c).alias(c) for c in ("size", "sketch", "words")])


def _places(pairs: DataFrame) -> np.ndarray:
    """Both lines of every pair as a bitmap of their places, keyed as in ``wanted_lines``."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                found = [mix(_place_key(np.asarray(batch[f"{side}_doc"]), np.asarray(batch[f"{side}_line"]).astype(np.int64)).view(np.uint64)) for side in ("later", "earlier")]
            yield pa.RecordBatch.from_arrays([pa.array(distinct(np.concatenate(found)).view(np.int64))], names=["place"])

    return _bitmap(pairs.select("later_doc", "later_line", "earlier_doc", "earlier_line").mapInArrow(key, "place long"), "place")


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parity bitmaps allow the threshold: they differ in at most as many bits as the sets may in words."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("a", "b"))
            both = np.asarray(batch["n"]).astype(np.int64) + np.asarray(batch["m"])
            need = np.ceil(both * (THRESHOLD / (1 + THRESHOLD)) - 1e-9).astype(np.int64)
            ok = pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= both - 2 * need)
            yield pa.RecordBatch.from_arrays([batch[c].filter(ok) for c in ("later", "earlier")], names=["later", "earlier"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            x, y = set(a.split()), set(b.split())
            both = len(x & y)
            good.append(both >= THRESHOLD * (len(x) + len(y) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch["later"], batch["check"], pa.array(good, pa.bool_())], names=["node", "check", "good"])


def matched_nodes(texts: DataFrame, rarity: np.ndarray, total: int) -> DataFrame:
    """``node``, ``check`` of every distinct line of which a different, earlier line is similar; ``total`` is the number of prefix rows."""
    spark = texts.sparkSession
    tasks = parts_for(total, TASK_ROWS)
    runs = materialise(prefix_rows(texts, spark.sparkContext.broadcast(rarity), 8 * tasks), "line-prefixes", "zstd")  # several a task, for even tasks
    usual, common = runs.where(F.col("bucket") != COMMON), runs.where(F.col("bucket") == COMMON)

    def settle(pairs: DataFrame) -> DataFrame:
        lines = materialise(wanted_lines(texts, spark.sparkContext.broadcast(_places(pairs))), "line-words")
        side = lambda node, words, *others: lines.select(F.col("node").alias(node), F.col(words[0]).alias(words[1]), *others)
        close = pairs.select("later", "earlier").distinct().join(side("earlier", ("sketch", "b"), F.col("size").alias("m")), "earlier").join(side("later", ("sketch", "a"), F.col("size").alias("n")), "later").mapInArrow(likely, "later long, earlier long")
        both = close.distinct().join(side("earlier", ("words", "b")), "earlier").join(side("later", ("words", "a"), "check"), "later")
        return both.mapInArrow(verify, "node long, check int, good boolean").where("good").select("node", "check").distinct()

    met, many = common_meetings(lambda keep=None: unpacked(common, keep))
    meetings = parts_for(many, TASK_ROWS)
    first = usual.repartition(tasks, "bucket").mapInArrow(lambda it: propose_runs(it, FIRST), PAIRS)
    pairs = materialise(first.unionByName(met.repartition(meetings, "meet").mapInArrow(lambda it: propose_rows(it, FIRST), PAIRS)), "line-pairs")
    good = materialise(settle(pairs), "line-matches")
    unsettled = pairs.where("more").select(F.col("later").alias("node"), "meet").distinct()
    open_lines = materialise(unsettled.join(good.select("node").distinct(), "node", "left_anti"), "open-lines")
    if open_lines.isEmpty():
        return good
    chosen, meets = (spark.sparkContext.broadcast(_bitmap(open_lines, c)) for c in ("node", "meet"))
    again = unpacked(usual, meets).unionByName(met).repartition(tasks + meetings, "meet")
    second = materialise(again.mapInArrow(lambda it: propose_rows(it, LAST, chosen.value), PAIRS), "line-pairs")
    return good.unionByName(settle(second)).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``mark`` (hash of the text) and the sorted numbers of the lines to remove; documents without any are absent."""
    texts = documents(docs).withColumn("mark", F.xxhash64("text"))
    table = materialise(texts.mapInArrow(facts, FACTS), "lines")
    total = table.where("line = -2").agg(F.sum("mark")).first()[0] or 0
    matched = matched_nodes(texts.select("doc_id", "text"), rarity_ranks(table), total).withColumn("matched", F.lit(True))
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.col("line").alias("line"))
    lines = table.where("line >= 0").select("leaf", "node", "check", "doc_id", "mark", "line", "n")
    leaders = lines.where("n > 0")
    firsts = leaders.groupBy("node", "check").agg(F.min(place).alias("first"), F.sum("n").alias("n")).join(matched, ["node", "check"], "left").where("n > 1 or matched")
    verdict = leaders.select("leaf", "node", "check").join(firsts.drop("n"), ["node", "check"])
    gone = lines.join(verdict, ["leaf", "node", "check"]).where(F.col("matched") | (place > F.col("first")))
    return materialise(gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line")).alias("gone")), "gone-lines")


def without_lines(docs: DataFrame) -> DataFrame:
    """``row`` (the document as it came), ``text`` without the removed lines, and ``lines``, ``gone``: how many it had and lost."""
    removed = removed_lines(docs).select(F.col("doc_id").alias("id"), F.col("mark").alias("its"), "gone")
    # a mask of a byte a line up to the last that goes: one pass over the lines, however many go
    gaps = F.transform("gone", lambda x, i: F.concat(F.repeat(F.lit("0"), F.when(i == 0, x).otherwise(x - F.get("gone", i - 1) - 1)), F.lit("1")))
    masks = removed.select("id", "its", F.size("gone").alias("n"), F.array_join(gaps, "").cast("binary").alias("mask"))
    texts = boxed(docs).withColumn("mark", F.xxhash64("text"))
    joined = texts.join(masks, texts["doc_id"].eqNullSafe(masks["id"]) & (texts["mark"] == masks["its"]), "left")
    pieces = F.split("text", "\n", -1)
    left = F.array_join(F.filter(pieces, lambda _, i: F.substring("mask", i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    return joined.select(
        "row",
        "doc_id",
        F.when(F.col("mask").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.when(F.col("text") == "", 0).otherwise(F.size(pieces)).cast("long").alias("lines"),
        F.coalesce("n", F.lit(0)).cast("long").alias("gone"),
    )


def report(docs: DataFrame) -> DataFrame:
    rows = without_lines(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.col("lines").alias("n_lines"), F.col("gone").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines; ``n_chars`` follows the text, and documents of which nothing but blanks is left go."""
    rows = without_lines(docs).where((F.col("gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    cut = F.col("gone") > 0
    new = {"text": F.when(cut, F.col("text")).otherwise(field("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(field("n_chars"))
    return rows.select(*[new.get(c, field(c)).alias(c) for c in docs.columns])
