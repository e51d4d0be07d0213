"""Substring dedup: repeated-phrase automata.

A window is WINDOW consecutive words. Each window is owned by the least-hashed of its ANCHOR-word phrases (the leftmost of equals), so
equal windows have equal owners at equal offsets. Three passes over whole texts:

1. Count owner phrases; those that occur twice mark a fixed-size bitmap, which only saves work: it lets windows pass that
   can recur, and never stops one that does.
2. Passed windows are counted by hash and the earliest (doc_id, start) is kept; a count of two confirms a recurring passage.
3. Documents stream their passed segments to shards by owner phrase. A shard compiles an Aho-Corasick automaton over the word
   sequences of its distinct runs of confirmed windows and locates every occurrence, so equality is settled on words; of the windows
   in an occurrence, those that aren't the earliest of their kind go.

Owners of more than SHARD_SEGMENTS segments are salted over several shards, and their confirmed windows are sent to each. The list of such
owners is a table, joined like any other.

Defined results: a null or empty text has no words; a null ``doc_id`` comes last; rows that repeat a ``doc_id`` are one document
as to order, so a window at the same start of both stays in both; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import documents, materialise, no_cycles, parts_for
from threadloom.llm.hashing import inside, sequence_keys, sliding_argmin, word_keys

WINDOW = 20
ANCHOR = 6
#: log2 of the bits of the bitmap: 16 MB, whatever the corpus.
BITMAP_BITS = 27
#: Segments that meet in one shard, about.
SHARD_SEGMENTS = 20_000
LAST = (1 << 63) - 1
STEP = 512


def owners(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word keys, words of each text, starts of all windows, and the position and key of each window's owner phrase."""
    words, counts = word_keys(texts)
    starts = np.flatnonzero(inside(counts, WINDOW))
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return words, counts, none, none, np.zeros(0, dtype=np.uint64)
    phrases = sequence_keys(words, ANCHOR)
    owner = sliding_argmin(phrases, WINDOW - ANCHOR + 1)[starts]
    return words, counts, starts, owner, phrases[owner]


def anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for lo in range(0, batch.num_rows, STEP):
            _, _, _, owner, key = owners([t.encode() for t in batch["text"].slice(lo, STEP).to_pylist()])
            found.append(key[np.r_[True, owner[1:] != owner[:-1]]] if len(owner) else key)
        key, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])


def bit_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def passed(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = bit_of(keys)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def recurring_bitmap(recurring: DataFrame) -> np.ndarray:
    """The bitmap of recurring anchors, gathered as at most 2 ** (BITMAP_BITS - 6) rows of 64 bits."""
    at = F.shiftrightunsigned("anchor", 64 - BITMAP_BITS)
    bits = recurring.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - BITMAP_BITS}) & 63 as int))").alias("bit"))
    got = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype="<i8")
    out[np.asarray(got["at"])] = np.asarray(got["bits"])
    return out.view(np.uint8)


def route_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(0x7FFFFFFF)).astype(np.int32)


def candidate_windows(docs: DataFrame, bitmap) -> DataFrame:
    """``window`` key, ``doc``, ``start`` and ``route`` of every window whose owner passes the bitmap."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                words, counts, starts, _, key = owners([t.encode() for t in part["text"].to_pylist()])
                ok = passed(key, bitmap.value)
                starts, key = starts[ok], key[ok]
                first = np.r_[0, np.cumsum(counts)]
                text = np.searchsorted(first, starts, side="right") - 1
                doc = np.array([LAST if d is None else d for d in part["doc_id"].to_pylist()], dtype=np.int64)
                window = sequence_keys(words, WINDOW)[starts] if len(starts) else key
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window.view(np.int64)), pa.array(doc[text]), pa.array((starts - first[text]).astype(np.int32)), pa.array(route_of(key))], names=["window", "doc", "start", "route"]
                )

    return docs.mapInArrow(emit, "window long, doc long, start int, route int")


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """``shard`` in place of ``route`` and ``salt``."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("route", "salt"), F.lit(shards)).cast("int")).drop("route", "salt")


def with_ways(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``ways``, over how many shards each row's owner is salted."""
    return rows.join(hot, "route", "left").withColumn("ways", F.coalesce("ways", F.lit(1)))


def segments(docs: DataFrame, bitmap, hot: DataFrame, shards: int) -> DataFrame:
    """Runs of passed windows with one owner, with their words, dealt to shards."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                texts = [t.encode() for t in part["text"].to_pylist()]
                _, counts, starts, owner, key = owners(texts)
                ok = passed(key, bitmap.value)
                starts, owner, key = starts[ok], owner[ok], key[ok]
                if not len(starts):
                    continue
                first = np.r_[0, np.cumsum(counts)]
                head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)])
                tail = np.r_[head[1:], len(starts)] - 1
                text = np.searchsorted(first, starts[head], side="right") - 1
                begin, end = starts[head] - first[text], starts[tail] - first[text] + WINDOW
                route = route_of(key[head])
                split: dict[int, list[bytes]] = {}
                slices = []
                for t, a, b in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True):
                    if t not in split:
                        split = {t: texts[t].split()}
                    slices.append(b" ".join(split[t][a:b]).decode())
                marks = np.asarray(part["mark"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route), part["doc_id"].take(pa.array(text)), pa.array(marks[text]), pa.array(begin.astype(np.int32)), pa.array(slices)],
                    names=["route", "doc_id", "mark", "start", "words"],
                )

    runs = with_ways(docs.mapInArrow(emit, "route int, doc_id long, mark long, start int, words string"), hot)
    return dealt(runs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark", "start"), "ways").cast("int")).drop("ways"), shards)


def confirmed_to_shards(confirmed: DataFrame, hot: DataFrame, shards: int) -> DataFrame:
    """Each confirmed window at every shard that its owner's segments go to."""
    salted = with_ways(confirmed, hot).select("window", "doc", "start", "route", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("salt"))
    return dealt(salted, shards)


FOUND = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("starts", pa.list_(pa.int32()))])


def locate(stream: pa.Table, confirmed: pa.Table) -> pa.Table:
    """``located`` without the cycle collector, which would only walk the words' codes again and again."""
    with no_cycles():
        return located(stream, confirmed)


def located(stream: pa.Table, confirmed: pa.Table) -> pa.Table:
    """Starts, segment by segment, of windows that begin earlier elsewhere, found by an automaton over the confirmed windows."""
    import ahocorasick

    if not stream.num_rows or not confirmed.num_rows:
        return FOUND.empty_table()
    texts = [t.encode() for t in stream["words"].to_pylist()]
    keys, counts = word_keys(texts)
    at = np.flatnonzero(inside(counts, WINDOW))
    window = sequence_keys(keys, WINDOW)[at]
    known = np.asarray(confirmed["window"]).view(np.uint64)
    order = np.argsort(known)
    place = np.minimum(np.searchsorted(known, window, sorter=order), len(known) - 1)
    hit = known[order[place]] == window
    at, which = at[hit], order[place[hit]]
    if not len(at):
        return FOUND.empty_table()
    first = np.r_[0, np.cumsum(counts)]
    text = np.searchsorted(first, at, side="right") - 1
    docs, marks, begins = stream["doc_id"].to_pylist(), stream["mark"].to_pylist(), np.asarray(stream["start"])
    doc = np.array([LAST if d is None else d for d in docs], dtype=np.int64)[text]
    doc0, start0 = np.asarray(confirmed["doc"]), np.asarray(confirmed["start"]).astype(np.int64)
    later = (doc0[which] != doc) | (start0[which] != at - first[text] + begins[text])
    head = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)])
    tail = np.r_[head[1:], len(at)]
    busy = np.add.reduceat(later, head) > 0  # runs of which every window is an earliest one lose nothing
    ids: dict[bytes, int] = {}
    coded: dict[int, tuple[int, ...]] = {}

    def code(i: int) -> tuple[int, ...]:
        if i not in coded:
            coded[i] = tuple([ids.setdefault(w, len(ids) + 1) for w in texts[i].split()])
        return coded[i]

    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    patterns: dict[tuple[int, int, int], int] = {}
    runs: list[np.ndarray] = []
    wanted: list[int] = []
    for lo, hi, live in zip(head.tolist(), tail.tolist(), busy.tolist(), strict=True):
        key = (int(which[lo]), int(which[hi - 1]), hi - lo)
        if key not in patterns:
            patterns[key] = len(runs)
            runs.append(which[lo:hi])
            i, begin = int(text[lo]), int(at[lo] - first[text[lo]])
            machine.add_word(code(i)[begin : begin + hi - lo + WINDOW - 1], patterns[key])
        if live and (not wanted or wanted[-1] != text[lo]):
            wanted.append(int(text[lo]))
    if not wanted:
        return FOUND.empty_table()
    machine.make_automaton()
    out: tuple[list, list, list] = ([], [], [])
    for i in wanted:
        own, shift = LAST if docs[i] is None else docs[i], int(begins[i]) - WINDOW + 2
        gone: set[int] = set()
        for end, pattern in machine.iter(code(i)):
            run = runs[pattern]
            starts = np.arange(end + shift - len(run), end + shift)
            gone.update(starts[(doc0[run] != own) | (start0[run] != starts)].tolist())
        if gone:
            for column, value in zip(out, (docs[i], marks[i], sorted(gone)), strict=True):
                column.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(out, FOUND.types, strict=True)], schema=FOUND)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``mark`` (hash of the text) and the starts of its windows that also start earlier; documents without any are absent."""
    spark = docs.sparkSession
    marked = documents(docs).withColumn("mark", F.xxhash64("text"))
    anchors = marked.select("text").mapInArrow(anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    recurring = materialise(anchors.where(F.col("n") > 1), "anchors")
    total = recurring.agg(F.sum("n")).first()[0] or 0
    route = F.col("anchor").bitwiseAND(0x7FFFFFFF).cast("int").alias("route")
    owned = recurring.groupBy(route).agg(F.sum("n").alias("n")).where(F.col("n") > SHARD_SEGMENTS)
    hot = materialise(owned.select("route", F.ceil(F.col("n") / SHARD_SEGMENTS).cast("int").alias("ways")), "hot")
    shards = parts_for(total, SHARD_SEGMENTS)
    bitmap = spark.sparkContext.broadcast(recurring_bitmap(recurring))
    windows = candidate_windows(marked.select("doc_id", "text"), bitmap)
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"), F.min("route").alias("route"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    confirmed = materialise(firsts.select("window", "first.doc", "first.start", "route"), "confirmed")
    stream = segments(marked, bitmap, hot, shards)
    found = stream.groupBy("shard").cogroup(confirmed_to_shards(confirmed, hot, shards).groupBy("shard")).applyInArrow(locate, "doc_id long, mark long, starts array<int>")
    return materialise(found, "located").groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words left, joined by single spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(batch["text"].to_pylist(), batch["starts"].to_pylist(), strict=True):
                words = text.encode().split()
                left = words
                if starts:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.asarray(starts) + WINDOW, -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    repeats = repeated_starts(docs).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "starts")
    marked = documents(docs).withColumn("mark", F.xxhash64("text"))
    joined = marked.join(repeats, marked["doc_id"].eqNullSafe(repeats["_id"]) & (marked["mark"] == repeats["_mark"]), "left")
    return joined.select("doc_id", "text", "starts").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
