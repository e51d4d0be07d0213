"""Near duplicates by sketches, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import sketch_dedup
from threadloom.llm.near_join import shingles


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    own = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(own):
        for j in range(i):
            if a and own[j] and 100 * len(a & own[j]) >= 85 * len(a | own[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        out.append((d, len(own[i]), min((x for x in ids if x is not None), default=None)))
    return sorted(((d, n, c, d == c) for d, n, c in out), key=str)


def rows(seed=4):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    base, chain = prose(120), prose(100)
    texts = [None, "", " \n\t\r\x0b\x0c", "One two", "one TWO", "one two three four five", "one two three four five six", "Ünder Älles ünder älles x", "ünder älles ünder älles x", " ".join(prose(9000))]
    texts += [texts[-1] + " tail"]
    for _ in range(60):  # a crowd of near copies: most are linked, some only through others, some not at all
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = r.choice(words)
        texts.append(" ".join(own))
    for _ in range(25):  # a chain: neighbours are linked, its ends are not
        chain = chain[2:] + prose(2)
        texts.append(" ".join(chain))
    for n in (5, 6, 7, 11, 24, 104):  # at and about the threshold
        own = prose(n)
        texts += [" ".join(own), " ".join(own + prose(1)), " ".join(own[: len(own) * 92 // 100] + prose(len(own) - len(own) * 92 // 100))]
    texts += [texts[12]] * 9 + [" ".join(base[:60] + prose(60)) for _ in range(12)] + [" ".join(prose(50)) for _ in range(40)]
    out = list(enumerate(texts))
    r.shuffle(out)
    return out + [(3, "again the same id, other words here"), (None, texts[13]), (None, None), (None, "all alone with no id at all"), out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    clash = [F.lit("x").alias(c) for c in ("node", "size", "bands", "component", "label", "bucket", "side")]
    return spark.createDataFrame(rows(), "doc_id long, text string").select("*", *clash).repartition(4)


@pytest.mark.parametrize("tile, shingle_count, direct", [(sketch_dedup.TILE, sketch_dedup.TILE_SHINGLES, 16), (8, sketch_dedup.TILE_SHINGLES, 16), (4, sketch_dedup.TILE_SHINGLES, 1), (3, 300, 0)])
def test_equals_all_pairs(docs, monkeypatch, tile, shingle_count, direct):
    """Whatever the size from which pieces are tiled and taken apart."""
    monkeypatch.setattr(sketch_dedup, "DIRECT_TILES", direct)
    monkeypatch.setattr(sketch_dedup, "TILE", tile)
    monkeypatch.setattr(sketch_dedup, "TILE_SHINGLES", shingle_count)
    got = [tuple(r) for r in sketch_dedup.report(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=str) == plain(rows())


def test_empty_table(docs):
    assert sketch_dedup.report(docs.limit(0)).count() == 0


def test_sketches_are_full_and_concentrated():
    r = np.random.default_rng(6)
    gaps = []
    for n in (1, 2, 30, 400):
        for share in (0.5, 0.85, 1.0):
            both = max(1, int(n * share))
            a = r.integers(0, 2**63, n).astype(np.uint64)
            b = np.r_[a[:both], r.integers(0, 2**63, n - both).astype(np.uint64)]
            signs = sketch_dedup.sketches(np.r_[a, b], np.array([n, n]))
            assert (signs < np.iinfo(np.uint64).max).all()
            gaps.append(abs((signs[0] == signs[1]).mean() - both / (2 * n - both)))
    assert max(gaps) < 0.12
    assert (sketch_dedup.sketches(np.zeros(0, np.uint64), np.array([0])) == np.iinfo(np.uint64).max).all()


def test_sketch_of_a_text_ignores_its_batch():
    texts = [b"a b c d e f g", b"", b"x y", b" ".join(b"w%d" % i for i in range(3000))]
    keys, sizes = shingles(texts)
    together = sketch_dedup.sketches(keys, sizes)
    for i, t in enumerate(texts):
        assert (sketch_dedup.sketches(*shingles([t]))[0] == together[i]).all()


def test_a_pair_is_verified_in_its_first_shared_bucket_only(monkeypatch):
    seen = []
    monkeypatch.setattr(sketch_dedup, "overlaps", lambda a, b, pairs: seen.append(len(pairs)) or np.zeros(len(pairs), dtype=int))
    bands = np.zeros((2, sketch_dedup.BANDS), dtype=np.int64)
    bands[0, 0], bands[1, 0] = 50, 60
    bands[:, 1:] = np.arange(1, sketch_dedup.BANDS)
    sets, label, rows_ = [np.arange(9, dtype=np.uint64)] * 2, np.array([0, 1]), np.array([0, 1])
    for bucket in range(1, sketch_dedup.BANDS):
        sketch_dedup.forest(sets, bands, label, rows_, rows_, bucket)
    assert seen == [1]
