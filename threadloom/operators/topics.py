"""Topics: non-negative factors of a sparse term table, for a grid of topic counts and seeds at once.

Documents lie in blocks of about STEP term entries: the numbers and weights of their terms, and beside them their loadings on all topics
of all models. A pass over the blocks multiplies the loadings, with the topics held, and sums what the topics need (loadings by terms,
loadings by loadings); the topics, at most MOST_TERMS wide, are then multiplied on the driver and sent round again. Both multiplications
repeat INNER times and never raise the loss; the passes end once no model's loss falls by TOLERANCE of its first. So documents are read
once a pass whatever the number of models, and only sums of a fixed size leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.annotation import assignment
from threadloom.operators.joins import parts_of
from threadloom.plans.fixpoint import discard, saved

#: The grid, the terms that count, and what a model is chosen by.
TOPIC_COUNTS, SEEDS = (6, 8, 10), (17, 29, 41)
LEAST_DOCUMENTS, LARGEST_SHARE, MOST_TERMS, TOP_TERMS, COHERENCE_TERMS = 5, 0.98, 5_000, 15, 10
SCORE = {"stability": 0.40, "coherence": 0.25, "diversity": 0.20, "error": 0.15}
INNER, TOLERANCE = 10, 1e-4
#: Term entries of a block, which a step multiplies at a time; one longer document is a block.
STEP = 600_000
#: A term's occurrences in one count from which that count names it at once; and terms of which the rest is counted by a broadcast.
NAMED, CANDIDATES = 5, 500_000
#: Bytes of text whose words are counted at a time, and documents that a task of a pass takes, about.
COUNT_STEP, TASK_DOCUMENTS = 6 << 20, 20_000
#: Terms whose sums are added up in one row.
SUM_TERMS = 128
TINY = 1e-12


def plain(text: Column) -> Column:
    """Lower-case text in which a blank stands for each run of anything but letters, digits and the low line; plain text stays."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")


def _word_pieces(batch: pa.RecordBatch, step: int) -> Iterator[tuple[slice, np.ndarray, pa.Array]]:
    """Documents in steps of about ``step`` bytes of their plain ``text``: which, each word's document and the words of two characters or
    more; a document's terms are these and the pairs of neighbours."""
    text = batch["text"]
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    ends = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + step, "right")) - 1)
        if ends[hi] > ends[lo]:
            data = np.frombuffer(text.buffers()[2], np.uint8)[ends[lo] : ends[hi]]
            letter = data != 32
            first = ends[lo:hi][ends[lo:hi] < ends[lo + 1 : hi + 1]] - ends[lo]  # texts that aren't empty
            fresh = letter.copy()
            fresh[1:] &= ~letter[:-1]
            fresh[first] = letter[first]
            head = np.flatnonzero(fresh)
            before = np.cumsum(letter, dtype=np.int32)
            offsets = np.r_[before[head] - 1, before[-1]].astype(np.int32)
            words = pa.Array.from_buffers(pa.string(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])])
            doc = np.searchsorted(ends[lo + 1 : hi + 1] - ends[lo], head, "right")
            long = pc.greater_equal(pc.utf8_length(words), 2)
            if pc.any(long).as_py():
                yield slice(lo, hi), doc[np.asarray(long)], words.filter(long)
        lo = hi


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term``, ``tf`` and ``df`` over some documents at a time."""
    for batch in batches:
        for rows, doc, words in _word_pieces(batch, COUNT_STEP):
            coded = words.dictionary_encode()
            names, word = coded.dictionary, np.asarray(coded.indices).astype(np.uint64)
            bits, shift = np.uint64(len(names).bit_length()), np.uint64((rows.stop - rows.start).bit_length())
            near = np.flatnonzero(doc[1:] == doc[:-1])
            code = np.r_[word, ((word[near] + np.uint64(1)) << bits) | word[near + 1]]
            at = np.sort((code << shift) | np.r_[doc, doc[near]].astype(np.uint64))
            code = at >> shift
            head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            fresh = np.r_[True, at[1:] != at[:-1]]
            a, b = (code[head] >> bits).astype(np.int64), names.take(pa.array((code[head] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)))
            pair = a > 0
            both = pc.binary_join_element_wise(names.take(pa.array(a[pair] - 1)), b.filter(pa.array(pair)), " ")
            terms = pa.concat_arrays([b.filter(pa.array(~pair)), both])
            tf, df = np.diff(np.r_[head, len(code)]), np.add.reduceat(fresh.astype(np.int64), head)
            yield pa.RecordBatch.from_arrays([terms] + [pa.array(np.r_[c[~pair], c[pair]].astype(np.int64)) for c in (tf, df)], names=["term", "tf", "df"])


def candidates(docs: DataFrame, text: str, n: int, least: int, share: float, most: int, made: bool = False) -> DataFrame | None:
    """Terms among which all of the vocabulary are; None if that can't be told from the terms that each count names.

    A count names the terms that it meets NAMED times or more, so what it doesn't name adds less than that. ``most`` terms that surely
    count have at least ``floor`` occurrences, and a term goes if it can't reach that. Most pairs of words are rare and never leave a task.
    """
    few = docs.select((F.col(text) if made else plain(F.col(text))).alias("text")).mapInArrow(lambda it: _named(_count_terms(it)), "term string, tf long, df long")
    named = saved(few.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.count(F.lit(1)).alias("counts")), "named")
    counts = named.where("term is null").agg(F.sum("counts")).first()[0] or 0
    spare = (counts - F.col("counts")) * (NAMED - 1)
    sure = named.where(F.col("term").isNotNull() & (F.col("df") >= least) & (F.col("df") + spare <= share * n))
    top = sure.orderBy(F.desc("tf")).limit(most).agg(F.min("tf"), F.count("tf")).first()
    floor = top[0] if most and top[1] == most else 0
    out = named.where(F.col("term").isNotNull() & (F.col("tf") + spare >= floor)).select("term")
    return out if floor > counts * (NAMED - 1) and out.count() <= CANDIDATES else None


def _named(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each count that it names, and a row without a term for the count itself."""
    for batch in found:
        yield batch.filter(pc.greater_equal(batch["tf"], NAMED))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([0]), pa.array([0])], names=["term", "tf", "df"])


def vocabulary(docs: DataFrame, text: str, least: int = LEAST_DOCUMENTS, share: float = LARGEST_SHARE, most: int = MOST_TERMS, made: bool = False) -> DataFrame:
    """``term``, ``at`` (its number) and ``idf`` of the most frequent terms that are in enough documents, but not in nearly all; texts may be
    made plain already."""
    n = docs.count()
    parts = docs.select((F.col(text) if made else plain(F.col(text))).alias("text")).mapInArrow(_count_terms, "term string, tf long, df long")
    some = candidates(docs, text, n, least, share, most, made)
    if some is not None:
        parts = parts.join(F.broadcast(some), "term", "left_semi")  # CANDIDATES rows
    counted = parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where((F.col("df") >= least) & (F.col("df") <= share * n))
    rows = counted.orderBy(F.desc("tf"), "term").limit(most).select("term", "df").collect()  # ``most`` rows
    table = [(r["term"], i, float(np.log((1 + n) / (1 + r["df"])) + 1)) for i, r in enumerate(sorted(rows, key=lambda r: r["term"]))]
    return docs.sparkSession.createDataFrame(table, "term string, at int, idf double")


def _flat_counts(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, terms and their counts, ascending, those of one term of one document summed."""
    code = (doc.astype(np.int64) << 32) | at
    order = np.argsort(code)
    code = code[order]
    head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[head] >> 32, code[head] & 0xFFFFFFFF, np.add.reduceat(n[order], head) if len(head) else n


def weighted_terms(docs: DataFrame, key: str, text: str, terms: DataFrame, made: bool = False) -> DataFrame:
    """``key``, ``at`` and ``x``: the numbers and weights (1 + ln tf, times idf, scaled to length one) of each document's terms.

    Documents without any of the terms are left out. Terms are counted where the text is; only their numbers and counts are dealt by key.
    """
    kind = dict(docs.dtypes)[key]
    table = terms.orderBy("at").collect()  # MOST_TERMS rows
    idf = np.array([r["idf"] for r in table])
    known = sorted({w for r in table for w in r["term"].split(" ")})
    number = {w: i for i, w in enumerate(known)}
    single = np.full(len(known) + 1, -1)
    pairs: list[tuple[int, int]] = []
    for r in table:
        own = [number[w] for w in r["term"].split(" ")]
        if len(own) == 1:
            single[own[0]] = r["at"]
        else:
            pairs.append((own[0] * len(known) + own[1], r["at"]))
    pair_codes, pair_at = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2).T

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(known, pa.string())
        for batch in batches:
            for rows, doc, words in _word_pieces(batch, COUNT_STEP):
                word = np.asarray(pc.index_in(words, value_set=values).fill_null(len(known))).astype(np.int64)
                near = np.flatnonzero((doc[1:] == doc[:-1]) & (word[1:] < len(known)) & (word[:-1] < len(known)))
                code = word[near] * len(known) + word[near + 1]
                place = np.minimum(np.searchsorted(pair_codes, code), max(0, len(pair_codes) - 1))
                hit = pair_codes[place] == code if len(pair_codes) else np.zeros(len(code), bool)
                at = np.r_[single[word], pair_at[place[hit]]]
                own = np.r_[doc, doc[near[hit]]][at >= 0]
                own, at, n = _flat_counts(own, at[at >= 0], np.ones(len(own), np.int64))
                size = np.bincount(own, minlength=rows.stop - rows.start)
                some = pa.array(np.flatnonzero(size))
                yield pa.RecordBatch.from_arrays([batch["key"].slice(rows.start, len(size)).take(some), _cut(at, size[size > 0], pa.int32()), _cut(n, size[size > 0], pa.int32())], names=[key, "at", "n"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch["at"].offsets)))
                doc, at, n = _flat_counts(doc, np.asarray(batch["at"].flatten()), np.asarray(batch["n"].flatten()))
                x = (1 + np.log(n)) * idf[at]
                size = np.bincount(doc, minlength=batch.num_rows)
                x = x / np.sqrt(np.add.reduceat(x * x, np.cumsum(size) - size))[doc]
                yield pa.RecordBatch.from_arrays([batch[key], _cut(at, size, pa.int32()), _cut(x, size, pa.float64())], names=[key, "at", "x"])

    found = docs.select(F.col(key).alias("key"), (F.col(text) if made else plain(F.col(text))).alias("text")).mapInArrow(count, f"{key} {kind}, at array<int>, n array<int>")
    dealt = found.repartition(_tasks(docs), key).groupBy(key).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("at", "n")])  # rows of a key are one document
    return dealt.mapInArrow(weigh, f"{key} {kind}, at array<int>, x array<double>")


def _tasks(docs: DataFrame) -> int:
    return max(parts_of(docs, TASK_DOCUMENTS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cut(flat: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat, kind))


@dataclass(frozen=True)
class Models:
    """Topics of all models, one below the other: ``h`` is (topics x terms), ``slices`` tells the models apart."""

    grid: list[tuple[int, int]]
    slices: list[slice]
    h: np.ndarray

    def blocks(self) -> np.ndarray:
        """Which topics are of one model, as a matrix of zeros and ones."""
        out = np.zeros((len(self.h), len(self.h)))
        for s in self.slices:
            out[s, s] = 1
        return out


def starting_models(counts: tuple[int, ...], seeds: tuple[int, ...], terms: int, scale: float) -> Models:
    """Topics of even random weights; ``scale`` is the mean weight of the term table, empty cells counted."""
    grid = [(k, s) for k in counts for s in seeds]
    ends = np.cumsum([k for k, _ in grid])
    h = [np.random.default_rng([s, k]).random((k, terms)) * 2 * np.sqrt(scale / k) for k, s in grid]
    return Models(grid, [slice(int(e) - k, int(e)) for (k, _), e in zip(grid, ends, strict=True)], np.concatenate(h))


def loadings(w: np.ndarray, xh: np.ndarray, hh: np.ndarray, times: int = INNER) -> np.ndarray:
    for _ in range(times):
        w = w * xh / np.maximum(w @ hh, TINY)
    return w


def next_topics(h: np.ndarray, wx: np.ndarray, ww: np.ndarray, times: int = INNER) -> np.ndarray:
    for _ in range(times):
        h = h * wx / np.maximum(ww @ h, TINY)
    return h


def losses(models: Models, wx: np.ndarray, ww: np.ndarray, xx: float) -> np.ndarray:
    """Squared distance of each model from the table, from the sums of a pass."""
    hh = models.h @ models.h.T
    return np.array([xx - 2 * (wx[s] * models.h[s]).sum() + (ww[s, s] * hh[s, s]).sum() for s in models.slices])


def _pieces(batch: pa.RecordBatch, step: int, name: str) -> Iterator[tuple[slice, np.ndarray, pa.Array]]:
    """Documents in steps of about ``step`` items of their lists ``name``: which, each item's document and the items."""
    sizes = np.diff(np.asarray(batch[name].offsets))
    flat = batch[name].flatten()
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + step, "right")))
        if ends[hi - 1] > base:
            yield slice(lo, hi), np.repeat(np.arange(hi - lo), sizes[lo:hi]), flat.slice(base, ends[hi - 1] - base)
        lo = hi


#: A block: its documents' keys, numbers of entries, terms, weights and loadings, as runs of numbers. A row with a ``part`` has sums instead.
BLOCK = {"size": pa.binary(), "at": pa.binary(), "x": pa.binary(), "w": pa.binary(), "part": pa.int32(), "sums": pa.binary()}
#: Parts of the sums: documents, weights and squared weights; loadings by loadings; from FIRST_TERMS on, loadings by terms.
WHOLE, LOADINGS, FIRST_TERMS = 0, 1, 2


def _block_schema(kind: str) -> str:
    return f"keys array<{kind}>, size binary, at binary, x binary, w binary, part int, sums binary"


def _block(keys: pa.Array, *runs: np.ndarray | bytes) -> pa.RecordBatch:
    columns = [pa.array([r if isinstance(r, bytes) else r.tobytes()], pa.binary()) for r in runs]
    own = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
    return pa.RecordBatch.from_arrays([own, *columns, pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names=["keys", *BLOCK])


def _sums_rows(keys: pa.DataType, sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    blank = [pa.nulls(len(sums), keys)] + [pa.nulls(len(sums), pa.binary())] * 4
    return pa.RecordBatch.from_arrays([*blank, pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float64).tobytes() for v in sums.values()], pa.binary())], names=["keys", *BLOCK])


def blocked(entries: DataFrame, key: str, terms: int, k: int) -> DataFrame:
    """Documents in blocks, each loaded with 1 / k of all topics, and each task's sums of the whole."""
    number = np.uint16 if terms <= 1 << 16 else np.uint32

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, kind = np.zeros(3), None
        for batch in batches:
            kind = batch.schema.field(key).type
            for rows, doc, at in _pieces(batch, STEP, "at"):
                n = rows.stop - rows.start
                part = batch.slice(rows.start, n)
                x = np.asarray(part["x"].flatten())
                whole += (n, x.sum(), x @ x)
                yield _block(part[key], np.bincount(doc, minlength=n).astype(np.int32), np.asarray(at).astype(number), x, np.full((n, k), 1.0 / k))
        if kind is not None:
            yield _sums_rows(pa.list_(kind), {WHOLE: whole})

    return entries.mapInArrow(emit, _block_schema(dict(entries.dtypes)[key]))


def _unpacked(row: dict, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.frombuffer(row["size"], np.int32)
    at = np.frombuffer(row["at"], np.uint16 if terms <= 1 << 16 else np.uint32)
    return size, at, np.frombuffer(row["x"], np.float64), np.frombuffer(row["w"], np.float64).reshape(len(size), -1)


def documents_of(state: DataFrame, key: str, terms: int) -> DataFrame:
    """``key``, ``at``, ``x`` and ``w``, a row a document."""
    kind = dict(state.dtypes)["keys"].removeprefix("array<").removesuffix(">")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                size, at, x, w = _unpacked({c: one[c][0].as_py() for c in ("size", "at", "x", "w")}, terms)
                yield pa.RecordBatch.from_arrays([one["keys"].flatten(), _cut(at, size, pa.int32()), _cut(x, size, pa.float64()), _cut(w.ravel(), np.full(len(size), w.shape[1]), pa.float64())], names=[key, "at", "x", "w"])

    return state.mapInArrow(emit, f"{key} {kind}, at array<int>, x array<double>, w array<double>")


def by_documents(size: np.ndarray, at: np.ndarray, x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Each document's weights times its terms' rows of ``h``."""
    out = np.zeros((len(size), h.shape[1]))
    room = np.empty((int(size.max(initial=0)), h.shape[1]))
    lo = 0
    for i, n in enumerate(size.tolist()):
        np.dot(x[lo : lo + n], np.take(h, at[lo : lo + n], axis=0, out=room[:n], mode="clip"), out=out[i])
        lo += n
    return out


def add_by_terms(total: np.ndarray, size: np.ndarray, at: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
    """Add to each term's row of ``total`` the loadings of its documents times its weights there."""
    order = np.argsort(at, kind="stable")
    doc, x = np.repeat(np.arange(len(size)), size)[order], x[order]
    many = np.bincount(at, minlength=len(total))
    room = np.empty((int(many.max(initial=0)), w.shape[1]))
    own = np.zeros_like(total)
    lo = 0
    for term, n in enumerate(many.tolist()):
        if n:
            np.dot(x[lo : lo + n], np.take(w, doc[lo : lo + n], axis=0, out=room[:n], mode="clip"), out=own[term])
        lo += n
    total += own


def _pass(state: DataFrame, models: Models) -> DataFrame:
    """Blocks with new loadings, and each task's sums of them by terms and by loadings."""
    hh, h = (models.h @ models.h.T) * models.blocks(), np.ascontiguousarray(models.h.T)
    terms, k = h.shape

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wx, ww = np.zeros((terms, k)), np.zeros((k, k))
        kind: pa.DataType | None = None
        for batch in batches:
            kind = batch.schema.field("keys").type
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {c: one[c][0].as_py() for c in ("size", "at", "x", "w")}
                size, at, x, w = _unpacked(row, terms)
                xh, w = by_documents(size, at, x, h), w.copy()
                for lo in range(0, len(w), 500):
                    w[lo : lo + 500] = loadings(w[lo : lo + 500], xh[lo : lo + 500], hh)
                add_by_terms(wx, size, at, x, w)
                ww += w.T @ w
                yield _block(one["keys"].flatten(), row["size"], row["at"], row["x"], w)
        if kind is not None:
            yield _sums_rows(kind, {LOADINGS: ww} | {FIRST_TERMS + i: wx[lo : lo + SUM_TERMS] for i, lo in enumerate(range(0, terms, SUM_TERMS))})

    return state.mapInArrow(emit, _block_schema(dict(state.dtypes)["keys"].removeprefix("array<").removesuffix(">")))


def _summed(table: pa.Table) -> pa.Table:
    """One row a part, its vectors summed."""
    total = np.sum([np.frombuffer(v, np.float64) for v in table["sums"].to_pylist()], axis=0)
    return pa.table({"part": table["part"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _sums(done: DataFrame) -> dict[int, np.ndarray]:
    parts = done.where("part is not null").select("part", "sums")
    got = parts.groupBy("part").applyInArrow(_summed, "part int, sums binary").toArrow()  # sums of topics by MOST_TERMS
    return {p: np.frombuffer(v, np.float64) for p, v in zip(got["part"].to_pylist(), got["sums"].to_pylist(), strict=True)}


def fit(entries: DataFrame, key: str, terms: int, counts: tuple[int, ...] = TOPIC_COUNTS, seeds: tuple[int, ...] = SEEDS, tolerance: float = TOLERANCE) -> tuple[Models, DataFrame, list[np.ndarray]]:
    """The models, the documents with their loadings on all topics, and the losses after each pass."""
    k = sum(counts) * len(seeds)
    done = saved(blocked(entries, key, terms, k), "entries")
    n, mass, xx = _sums(done).get(WHOLE, np.zeros(3))
    models = starting_models(counts, seeds, terms, mass / max(1, n * terms))
    trace: list[np.ndarray] = []
    while n:
        before, done = done, saved(_pass(_blocks(done), models), "loadings")
        discard(before)
        sums = _sums(done)
        wx = np.concatenate([sums[p] for p in sorted(sums) if p >= FIRST_TERMS]).reshape(terms, k).T
        ww = sums[LOADINGS].reshape(k, k) * models.blocks()
        trace.append(losses(models, wx, ww, xx))
        if len(trace) > 1 and (trace[-2] - trace[-1] < tolerance * trace[0]).all():
            break
        models = Models(models.grid, models.slices, next_topics(models.h, wx, ww))
    return models, documents_of(_blocks(done), key, terms), trace


def _blocks(done: DataFrame) -> DataFrame:
    return done.where("part is null").select("keys", "size", "at", "x", "w")


def top_terms(models: Models, names: list[str], many: int = TOP_TERMS) -> list[list[list[int]]]:
    """Numbers of the heaviest terms of each topic of each model; ties by the term."""
    order = lambda row: sorted(range(len(names)), key=lambda i: (-row[i], names[i]))[:many]
    return [[order(row) for row in models.h[s]] for s in models.slices]


def coherence(state: DataFrame, tops: list[list[list[int]]], many: int = COHERENCE_TERMS) -> list[float]:
    """Mean over a model's topics and pairs of their heaviest terms of ln((documents with both + 1) / documents with the second)."""
    flat = [topic[:many] for model in tops for topic in model]
    chosen = np.array(sorted({term for topic in flat for term in topic}), dtype=np.int64)
    own = [np.searchsorted(chosen, topic) for topic in flat]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(chosen), len(chosen)))
        for batch in batches:
            for rows, doc, at in _pieces(batch, STEP, "at"):
                at = np.asarray(at)
                place = np.searchsorted(chosen, at)
                hit = np.flatnonzero(chosen[np.minimum(place, len(chosen) - 1)] == at) if len(chosen) else np.zeros(0, np.int64)
                seen = np.zeros((rows.stop - rows.start, len(chosen)), dtype=np.float32)  # sums of ones are exact up to 2 ** 24 documents
                seen[doc[hit], place[hit]] = 1
                both += seen.T @ seen
        total = np.zeros((len(flat), many, many), dtype=np.int64)
        for t, places in enumerate(own):
            total[t, : len(places), : len(places)] = both[np.ix_(places, places)]
        t, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in (t, i, j)] + [pa.array(total[t, i, j])], names=["t", "i", "j", "n"])

    counts = np.zeros((len(flat), many, many))
    for r in state.select("at", "x").mapInArrow(emit, "t int, i int, j int, n long").groupBy("t", "i", "j").agg(F.sum("n").alias("n")).collect():  # topics x 100 rows
        counts[r["t"], r["i"], r["j"]] = r["n"]
    out, at = [], 0
    for model in tops:
        own = []
        for topic in model:
            c, m = counts[at], len(topic[:many])
            pairs = [np.log((c[i, j] + 1) / max(c[j, j], 1)) for i in range(m) for j in range(i + 1, m)]
            own.append(float(np.mean(pairs)) if pairs else 0.0)
            at += 1
        out.append(float(np.mean(own)) if own else 0.0)
    return out


def alignment(left: list[list[int]], right: list[list[int]]) -> float:
    """Mean Jaccard of the terms of topics paired one to one for the greatest total."""
    if not left or not right:
        return float(not left and not right)
    scores = np.array([[len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0 for b in right] for a in left])
    return float(np.mean([scores[i, j] for i, j in assignment(scores)]))


def diversity(topics: list[list[int]]) -> float:
    every = [t for topic in topics for t in topic]
    return len(set(every)) / len(every) if every else 0.0


def selection_scores(rows: dict[int, dict[str, float]]) -> dict[int, float]:
    """A score for each topic count: its measures scaled to 0 .. 1 over the counts (1 where all are equal), the error turned round."""

    def scaled(name: str, k: int) -> float:
        values = [r[name] for r in rows.values()]
        low, high = min(values), max(values)
        share = 1.0 if high == low else (rows[k][name] - low) / (high - low)
        return share if high == low or name != "error" else 1 - share

    return {k: sum(weight * scaled(name, k) for name, weight in SCORE.items()) for k in rows}


def assigned(state: DataFrame, key: str, models: Models) -> DataFrame:
    """``key``, ``model`` (its place in the grid), ``topic`` of the greatest loading (ties: the first) and the ``loading``."""
    own = [F.struct(F.lit(i).alias("model"), F.slice("w", s.start + 1, s.stop - s.start).alias("own")) for i, s in enumerate(models.slices)]
    rows = state.select(key, F.explode(F.array(*own)).alias("m")).select(key, "m.model", "m.own")
    return rows.select(key, "model", (F.array_position("own", F.array_max("own")) - 1).cast("int").alias("topic"), F.array_max("own").alias("loading"))


@dataclass(frozen=True)
class Chosen:
    """What ``select_model`` found: a row a model, the chosen one's place in the grid, and its topics' terms."""

    table: list[tuple]
    model: int
    terms: list[list[str]]


def select_model(state: DataFrame, key: str, models: Models, trace: list[np.ndarray], names: list[str]) -> Chosen:
    """Every model measured; of the topic count with the best score (ties: stability, coherence, the smaller count) the seed with least error."""
    tops = top_terms(models, names)
    meant = coherence(state, tops)
    errors = np.sqrt(np.maximum(trace[-1], 0))
    support = {(r["model"], r["topic"]): r["n"] for r in assigned(state, key, models).groupBy("model", "topic").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a topic
    of_count: dict[int, list[int]] = {}
    for i, (k, _) in enumerate(models.grid):
        of_count.setdefault(k, []).append(i)
    rows = {}
    for k, own in of_count.items():
        pairs = [alignment(tops[i], tops[j]) for i, j in combinations(own, 2)]
        rows[k] = {"stability": float(np.mean(pairs)) if pairs else 1.0, "coherence": float(np.mean([meant[i] for i in own])), "diversity": float(np.mean([diversity(tops[i]) for i in own])), "error": float(min(errors[i] for i in own))}
    scores = selection_scores(rows)
    count = min(rows, key=lambda k: (-scores[k], -rows[k]["stability"], -rows[k]["coherence"], k))
    model = min(of_count[count], key=lambda i: (errors[i], models.grid[i][1]))
    table = [
        (k, s, float(errors[i]), meant[i], diversity(tops[i]), rows[k]["stability"], min(support.get((i, t), 0) for t in range(k)), scores[k], i == model)
        for i, (k, s) in enumerate(models.grid)
    ]
    return Chosen(table, model, [[names[t] for t in topic] for topic in tops[model]])


MODEL_COLUMNS = "topic_count int, seed int, error double, coherence double, diversity double, stability double, least_support long, score double, selected boolean"


def topic_models(docs: DataFrame, key: str, text: str, **grid) -> tuple[DataFrame, Chosen, Models]:
    """Documents with their loadings, the chosen model and all models' topics.

    Texts are first dealt over tasks, since a file may be a single row group, and made plain once.
    """
    docs = saved(docs.select(key, text).repartition(_tasks(docs)).select(key, plain(F.col(text)).alias(text)), "texts")
    terms = vocabulary(docs, text, made=True)
    names = [r["term"] for r in terms.orderBy("at").collect()]  # MOST_TERMS rows
    models, state, trace = fit(weighted_terms(docs, key, text, terms, made=True), key, len(names), **grid)
    discard(docs)
    if not trace:
        return state, Chosen([], 0, []), models
    return state, select_model(state, key, models, trace, names), models
