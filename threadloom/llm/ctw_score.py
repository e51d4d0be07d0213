"""LM scoring by context-tree weighting over binary-decomposed bytes.

Every byte of a lower-cased text is eight binary decisions, each with a Krichevsky-Trofimov estimator in every suffix of the
DEPTH bytes before it. A node's weighted probability is half its own KT block probability plus half the product of its
children's; from counts alone that follows bottom-up, and the weights it leaves mix the estimates of all depths when a text is
scored. A subtree that training never visited defers to its parent. A text is padded in front with zero bytes and closed by
the byte 255, which no UTF-8 text holds, so scores are log probabilities of whole texts.

Counts are gathered from the whole training fold: chunks of documents count their distinct grams, sums go by gram, and the
tree is built in shards by the last two context bytes; only the top of the tree (at most 256 contexts of one byte) meets on the
driver. Values travel back to the chunks that hold the grams, so no table that grows with the corpus is broadcast or collected.

Words for the base score are counted the same way, keyed by a 64-bit polynomial hash.

Defined results: a null or empty text is the end token alone; a null ``doc_id`` is in the training fold; repeated rows count
and score each; an empty training fold leaves every bit at one half; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import documents, materialise, parts_for, thrifty
from threadloom.llm.hashing import distinct, word_keys

DEPTH = 5
#: Texts, and bytes of text, of a chunk, about.
CHUNK_ROWS, CHUNK_BYTES = 12288, 40 << 20
#: Texts, and bytes of text, of a chunk whose keys are held at a time; one longer text is taken alone.
STEP, STEP_BYTES = 512, 2 << 20
SHARD_GRAMS = 150_000
#: Grams of a shard whose tree is held at a time, about; one two-byte context with more is taken alone.
PIECE = 32_768
END = 255
GRAM, WORD = 0, 1
#: The end token's key; words have mixed, practically never zero, hashes.
END_WORD = np.uint64(0)


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (DEPTH context bytes, then the byte) of every byte and end of the texts, and how many each text has."""
    pad = bytes(DEPTH)
    flat = np.frombuffer(pad + (bytes([END]) + pad).join(texts) + bytes([END]), dtype=np.uint8)
    counts = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    keys = np.zeros(len(flat) - DEPTH, dtype=np.uint64)
    for k in range(DEPTH + 1):
        keys <<= np.uint64(8)
        keys |= flat[k : k + len(keys)]
    inside = np.ones(len(keys), dtype=bool)
    gaps = np.cumsum(counts[:-1] + DEPTH) - DEPTH
    inside[(gaps[:, None] + np.arange(DEPTH)).ravel()] = False
    return keys[inside], counts


def _by_parts(keys_of, texts: list[bytes], each: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """``keys_of`` a few texts at a time: its scratch arrays then stay in cache."""
    found = [keys_of(texts[lo : lo + each]) for lo in range(0, len(texts), each)]
    return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def in_training(doc_ids: list) -> np.ndarray:
    import zlib

    return np.array([d is None or zlib.crc32(str(d).encode()) % 7 != 2 for d in doc_ids], dtype=bool)


def _tally(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs in training."""
    train = np.sort(keys[trained])
    head = np.flatnonzero(np.r_[True, train[1:] != train[:-1]]) if len(train) else np.zeros(0, np.int64)
    own, n = train[head], np.diff(np.r_[head, len(train)])
    every = distinct(keys[~trained])
    if len(own):
        every = every[own[np.minimum(np.searchsorted(own, every), len(own) - 1)] != every]
    return np.r_[own, every], np.r_[n, np.zeros(len(every), dtype=n.dtype)]


def _lower(table: pa.Table) -> list[bytes]:
    return [t.encode().lower() for t in table["text"].to_pylist()]


def _merged(tallies: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One tally of several."""
    keys, n = (np.concatenate(x) for x in zip(*tallies, strict=True))
    order = np.argsort(keys, kind="stable")  # a few sorted runs
    keys, n = keys[order], n[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[head], np.add.reduceat(n, head)


def _push(tallies: list[tuple[np.ndarray, np.ndarray]], new: tuple[np.ndarray, np.ndarray]) -> None:
    """Add a tally; each of the list is more than twice as long as the next, so few keys are held twice."""
    tallies.append(new)
    while len(tallies) > 1 and 2 * len(tallies[-1][0]) >= len(tallies[-2][0]):
        tallies.append(_merged([tallies.pop(), tallies.pop()]))


def _steps(table: pa.Table) -> Iterator[pa.Table]:
    """A chunk's rows, a bounded number and size at a time."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(table["text"]), 0)), dtype=np.int64)
    lo = 0
    while lo < table.num_rows:
        done = ends[lo - 1] if lo else 0
        hi = min(lo + STEP, max(lo + 1, int(np.searchsorted(ends, done + STEP_BYTES, side="right"))))
        yield table.slice(lo, hi - lo)
        lo = hi


def count_chunk(table: pa.Table) -> pa.Table:
    chunk, found = table["chunk"][0].as_py(), {GRAM: [], WORD: []}
    for part in _steps(table):
        texts, train = _lower(part), in_training(part["doc_id"].to_pylist())
        keys, counts = _by_parts(gram_keys, texts)
        _push(found[GRAM], _merged([_tally(keys, np.repeat(train, counts))]))
        keys, counts = _by_parts(word_keys, texts)
        _push(found[WORD], _merged([_tally(np.r_[keys, np.full(len(texts), END_WORD)], np.r_[np.repeat(train, counts), train])]))
    out = []
    for kind, tallies in found.items():
        key, n = _merged(tallies)
        out.append(pa.table({"chunk": np.full(len(key), chunk, np.int32), "kind": np.full(len(key), kind, np.int32), "key": key.view(np.int64), "n": n.astype(np.int64)}))
    return pa.concat_tables(out)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma for x >= 0.5: seven steps up, then Stirling's series."""
    y = x + 7
    low = np.ones_like(x)
    for k in range(7):
        low = low * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def block_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the KT block probability of a node."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - math.log(math.pi) - _lgamma(n0 + n1 + 1.0)


def half_sum(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - math.log(2)


class _Level:
    """The nodes of one depth: distinct (context, bit prefix), their counts and logs."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray | None):
        self.ids, self.at = np.unique(ids, return_inverse=True)
        k = len(self.ids)
        self.n0, self.n1 = np.bincount(self.at, n0, k), np.bincount(self.at, n1, k)
        own = block_log(self.n0, self.n1)
        if children is None:
            self.weight, self.log = np.ones(k), own
        else:
            self.log = half_sum(own, np.bincount(self.at, children, k))
            self.weight = np.exp(own - math.log(2) - self.log)
        self.seen = self.n0 + self.n1 > 0

    def estimate(self, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        n0, n1 = self.n0[at], self.n1[at]
        return (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)


def _decisions(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight rows a key: context, node (bit prefix with a leading one) and bit."""
    byte, ctx = key & np.uint64(255), key >> np.uint64(8)
    step = np.arange(8, dtype=np.uint64)
    node = (np.uint64(1) << step) | (byte[:, None] >> (np.uint64(8) - step))
    bit = (byte[:, None] >> (np.uint64(7) - step)) & np.uint64(1)
    return np.repeat(ctx, 8), node.ravel(), bit.ravel()


def deep_levels(key: np.ndarray, n: np.ndarray) -> tuple[list[_Level], list[np.ndarray], np.ndarray]:
    """Levels DEPTH .. 2, the index of each decision in each, and the decisions' bits."""
    ctx, node, bit = _decisions(key)
    count = np.repeat(n.astype(float), 8)
    levels, places = [], []
    ids, n0, n1, children = (ctx << np.uint64(8)) | node, count * (bit == 0), count * (bit == 1), None
    place = None
    for depth in range(DEPTH, 1, -1):
        level = _Level(ids, n0, n1, children)
        place = level.at if place is None else level.at[place]
        levels.append(level)
        places.append(place)
        own = level.ids
        mask = np.uint64((1 << 8 * (depth - 1)) - 1)
        ids = (((own >> np.uint64(8)) & mask) << np.uint64(8)) | (own & np.uint64(255))
        n0, n1, children = level.n0, level.n1, level.log
    return levels, places, bit


def _pieces(key: np.ndarray) -> Iterator[np.ndarray]:
    """Places of a shard's grams, whole two-byte contexts at a time: their trees have no node of depth 2 or more in common."""
    last = ((key >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16)
    order = np.argsort(last, kind="stable")
    last = last[order]
    ends = np.r_[np.flatnonzero(last[1:] != last[:-1]) + 1, len(key)]
    lo = 0
    while lo < len(key):
        i = int(np.searchsorted(ends, lo + PIECE, side="right"))
        hi = int(ends[i - 1] if i and ends[i - 1] > lo else ends[i])
        yield order[lo:hi]
        lo = hi


def shard_tops(table: pa.Table) -> pa.Table:
    """Nodes of depth 2 that a shard's grams make."""
    key, n, out = np.asarray(table["key"]).view(np.uint64), np.asarray(table["n"]), []
    for at in _pieces(key):
        top = deep_levels(key[at], n[at])[0][-1]
        ctx = (top.ids >> np.uint64(8)).astype(np.int64)
        out.append(pa.table({"last": ctx & 255, "node": (top.ids & np.uint64(255)).astype(np.int64), "n0": top.n0, "n1": top.n1, "log": top.log}))
    return pa.concat_tables(out)


def byte_tops(table: pa.Table) -> pa.Table:
    """Nodes of depth 1 of one last byte, from the sums over its depth-2 contexts."""
    n0, n1, node = (np.asarray(table[c]) for c in ("n0", "n1", "node"))
    own = block_log(n0, n1)
    log = half_sum(own, np.asarray(table["log"]))
    return pa.table({"last": table["last"], "node": node, "n0": n0, "n1": n1, "log": log, "weight": np.exp(own - math.log(2) - log)})


def upper_tree(rows: pa.Table) -> dict[str, np.ndarray]:
    """Counts and weights of depths 1 and 0 as arrays over (last byte, node) and (node)."""
    n0, n1, log, weight = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256)), np.full((256, 256), 0.5)
    at = np.asarray(rows["last"]), np.asarray(rows["node"])
    n0[at], n1[at], log[at], weight[at] = (np.asarray(rows[c]) for c in ("n0", "n1", "log", "weight"))
    own = block_log(n0.sum(0), n1.sum(0))
    return {"n0": n0, "n1": n1, "weight": weight, "root_weight": np.exp(own - math.log(2) - half_sum(own, log.sum(0)))}


def shard_scores(table: pa.Table, upper: dict[str, np.ndarray]) -> pa.Table:
    """The log10 probability of each gram's byte after its context."""
    key, n = np.asarray(table["key"]).view(np.uint64), np.asarray(table["n"])
    value = np.empty(len(key))
    for at in _pieces(key):
        value[at] = _piece_scores(key[at], n[at], upper)
    return pa.table({"key": table["key"], "value": value})


def _piece_scores(key: np.ndarray, n: np.ndarray, upper: dict[str, np.ndarray]) -> np.ndarray:
    levels, places, bit = deep_levels(key, n)
    p = levels[0].estimate(places[0], bit)
    below = levels[0].seen[places[0]]
    for level, at in zip(levels[1:], places[1:], strict=True):
        own, w = level.estimate(at, bit), level.weight[at]
        p = np.where(below, w * own + (1 - w) * p, own)
        below = level.seen[at]
    ctx, node, _ = _decisions(key)
    last, node = (ctx & np.uint64(255)).astype(np.int64), node.astype(np.int64)
    for n0, n1, w in ((upper["n0"][last, node], upper["n1"][last, node], upper["weight"][last, node]), (upper["n0"].sum(0)[node], upper["n1"].sum(0)[node], upper["root_weight"][node])):
        own = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
        p = np.where(below, w * own + (1 - w) * p, own)
        below = n0 + n1 > 0
    return np.log10(p).reshape(-1, 8).sum(axis=1)


def _by_text(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total, at = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(counts)]
    return total[at[1:]] - total[at[:-1]]


def score_chunk(docs: pa.Table, values: pa.Table, tokens: int, distinct: int) -> pa.Table:
    """Sums over each document of a chunk, from the values of the chunk's distinct grams and words."""
    kind, keys, value = np.asarray(values["kind"]), np.asarray(values["key"]).view(np.uint64), np.asarray(values["value"])
    known = {}
    for which in (GRAM, WORD):
        at = np.flatnonzero(kind == which)
        at = at[np.argsort(keys[at])]
        known[which] = keys[at], value[at]
    del kind, keys, value

    def found(which: int, wanted: np.ndarray) -> np.ndarray:
        own, its = known[which]
        return its[np.searchsorted(own, wanted)]

    end = float(found(WORD, np.array([END_WORD]))[0]) if docs.num_rows else 0.0
    floor, out = tokens + distinct + 1, []
    for part in _steps(docs):
        texts, ids = _lower(part), part["doc_id"].to_pylist()
        grams, sizes = _by_parts(gram_keys, texts)
        words, n_words = _by_parts(word_keys, texts)
        c = found(WORD, words)
        out.append(
            pa.table(
                {
                    "doc_id": part["doc_id"],
                    "held_out": ~in_training(ids),
                    "n_tokens": (n_words + 1).astype(np.int64),
                    "n_known": (_by_text((c > 0).astype(np.int64), n_words) + (end > 0)).astype(np.int64),
                    "train_tokens": np.full(len(ids), tokens, np.int64),
                    "base_score": _by_text(np.log10((c + 1) / floor), n_words) + math.log10((end + 1) / floor),
                    "score": np.add.reduceat(found(GRAM, grams), np.r_[0, np.cumsum(sizes)[:-1]]),
                    "bytes": (sizes - 1).astype(np.int64),
                }
            )
        )
    return pa.concat_tables(out)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes long"


def score_documents(docs: DataFrame) -> DataFrame:
    rows = documents(docs)
    many, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    chunks = max(parts_for(many, CHUNK_ROWS), parts_for(size or 0, CHUNK_BYTES))
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    items = materialise(chunked.groupBy("chunk").applyInArrow(thrifty(count_chunk), "chunk int, kind int, key long, n long"), "items")
    counts = materialise(items.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    is_word, is_gram = F.col("kind") == WORD, F.col("kind") == GRAM
    known = F.col("n") > 0
    sums = counts.agg(
        F.sum(F.when(is_word, F.col("n"))).alias("tokens"), F.count(F.when(is_word & known, 1)).alias("distinct"), F.count(F.when(is_gram, 1)).alias("grams")
    ).first()
    tokens, distinct = sums["tokens"] or 0, sums["distinct"]
    shard = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(parts_for(sums["grams"], SHARD_GRAMS))).cast("int")
    grams = counts.where(is_gram).select("key", "n", shard.alias("shard"))
    tops = grams.where(known).groupBy("shard").applyInArrow(thrifty(shard_tops), "last long, node long, n0 double, n1 double, log double")
    # at most 256 * 255 rows, whatever the corpus: one a last byte and node
    nodes = tops.groupBy("last", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log").alias("log"))
    upper = upper_tree(byte_tops(nodes.toArrow().sort_by([("last", "ascending"), ("node", "ascending")])))
    scores = grams.groupBy("shard").applyInArrow(thrifty(lambda t: shard_scores(t, upper)), "key long, value double").withColumn("kind", F.lit(GRAM))
    words = counts.where(is_word).select("key", F.col("n").cast("double").alias("value"), F.lit(WORD).alias("kind"))
    values = items.select("chunk", "kind", "key").join(scores.unionByName(words), ["kind", "key"])
    return chunked.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(thrifty(lambda d, v: score_chunk(d, v, tokens, distinct)), RESULT)


def report(docs: DataFrame) -> DataFrame:
    """Scores, with the code length in bits a byte."""
    return score_documents(docs).withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.greatest(F.col("bytes"), F.lit(1))).drop("bytes")
