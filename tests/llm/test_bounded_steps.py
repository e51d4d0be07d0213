"""Small steps, pieces and shards give the results of a plain computation."""

import hashlib
import math
import zlib
from collections import defaultdict
from functools import cache

import pytest

from threadloom.llm import ctw_score, phrase_dedup

TEXTS = [None, "", "  ", "Abracadabra abracadabra", "the cat sat on the mat\nThe cat", "the cat sat on the mat", "naïve ÄÖ 你好", "x" * 700] + [f"row {i % 5} of the table, {i * 37 % 11}" for i in range(30)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def decisions(text):
    data = bytes(5) + (text or "").encode().lower() + b"\xff"
    for i in range(5, len(data)):
        for k in range(8):
            yield data[i - 5 : i], (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1


def plain_scores():
    counts, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    for d, t in enumerate(TEXTS):
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for context, node, bit in decisions(t):
                for depth in range(6):
                    own = context[5 - depth :]
                    counts[own, node][bit] += 1
                    if depth:
                        below[own[1:], node].add(own)

    def block(own, node):
        n0, n1 = counts[own, node]
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)

    @cache
    def weighted(own, node):
        if len(own) == 5:
            return block(own, node)
        a, b = block(own, node), sum(weighted(c, node) for c in below[own, node])
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) - math.log(2)

    def chance(context, node, bit):
        p, known = 0.5, False
        for depth in range(5, -1, -1):
            own = context[5 - depth :]
            n = counts.get((own, node), [0, 0])
            here = (n[bit] + 0.5) / (sum(n) + 1)
            w = math.exp(block(own, node) - math.log(2) - weighted(own, node)) if sum(n) and depth < 5 else 1.0
            p = w * here + (1 - w) * p if known else here  # a child that training never visited defers to its parent
            known = sum(n) > 0
        return p

    return {d: sum(math.log10(chance(*x)) for x in decisions(t)) for d, t in enumerate(TEXTS)}


def test_context_trees(rows):
    want = plain_scores()
    got = {r.doc_id: r.score for r in ctw_score.report(rows).collect()}
    assert got == pytest.approx(want, rel=1e-7)


def test_counts_of_small_steps_are_the_same(monkeypatch):
    import pyarrow as pa

    table = pa.table({"chunk": pa.array([0] * len(TEXTS), pa.int32()), "doc_id": pa.array(range(len(TEXTS))), "text": [t or "" for t in TEXTS]})
    want = ctw_score.count_chunk(table)
    monkeypatch.setattr(ctw_score, "STEP", 3)
    assert ctw_score.count_chunk(table).sort_by([("kind", "ascending"), ("key", "ascending")]).equals(want.sort_by([("kind", "ascending"), ("key", "ascending")]))


def test_small_pieces_score_the_same(monkeypatch):
    import numpy as np
    import pyarrow as pa

    counted = ctw_score.count_chunk(pa.table({"chunk": pa.array([0] * len(TEXTS), pa.int32()), "doc_id": pa.array(range(len(TEXTS))), "text": [t or "" for t in TEXTS]}))
    grams = counted.filter(pa.compute.equal(counted["kind"], ctw_score.GRAM))

    def scored():
        tops = ctw_score.shard_tops(grams).group_by(["last", "node"]).aggregate([("n0", "sum"), ("n1", "sum"), ("log", "sum")]).rename_columns(["last", "node", "n0", "n1", "log"])
        out = ctw_score.shard_scores(grams, ctw_score.upper_tree(ctw_score.byte_tops(tops))).sort_by("key")
        return np.asarray(out["key"]), np.asarray(out["value"])

    whole = scored()
    monkeypatch.setattr(ctw_score, "PIECE", 5)
    small = scored()
    assert (whole[0] == small[0]).all() and np.allclose(whole[1], small[1], rtol=1e-9)


def test_phrases_of_hot_owners(spark, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "SHARD_SEGMENTS", 3)
    passage = " ".join(f"w{i}" for i in range(40))
    texts = [f"a{i} b{i} {passage} c{i} {passage if i % 3 == 0 else ''}" for i in range(40)] + [None, "", passage, "short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    words = {d: (t or "").encode().split() for d, t in enumerate(texts)}
    first, want = {}, set()
    for d, w in words.items():
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (d, s))
    for d, w in words.items():
        gone = {j for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (d, s) for j in range(s, s + 20)}
        want.add((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    assert set(map(tuple, phrase_dedup.report(docs).collect())) == want
