"""Operators over all documents of a small scale, against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest

from threadloom.llm import line_dedup, near_join, phrase_dedup

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(5)


def similar_before(sets):
    """For each set, whether an earlier one has Jaccard 0.8 or more; by shared elements of an inverted index."""
    where, out = defaultdict(list), []
    for i, s in enumerate(sets):
        need = len(s) - math.ceil(0.8 * len(s) - 1e-9) + 1
        seen = {j for x in sorted(s, key=lambda x: len(where[x]))[:need] for j in where[x]}
        out.append(any(len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9 for j in seen))
        for x in s:
            where[x].append(i)
    return out


def test_lines(docs, texts):
    lines = [(d, k, frozenset(x.split())) for d, t in texts for k, x in enumerate(t.encode().split(b"\n")) if x.split()]
    gone = {(d, k) for (d, k, _), g in zip(lines, similar_before([s for _, _, s in lines]), strict=True) if g}
    want = set()
    for d, t in texts:
        pieces = t.split("\n")
        left = [x for k, x in enumerate(pieces) if (d, k) not in gone]
        want.add((d, len(pieces) if t else 0, len(pieces) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    assert set(map(tuple, line_dedup.report(docs).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect())) == want


def test_similarity_links(docs, texts):
    def shingles(t):
        w = t.lower().encode().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {d: shingles(t) for d, t in texts}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    links, root = Counter(), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in where[x] if e < d).items():
            if both >= 0.8 * (len(s) + len(sets[e]) - both) - 1e-9:
                links[d] += 1
                links[e] += 1
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    got = near_join.report(docs).collect()
    assert {(r.doc_id, r.n_links) for r in got} == {(d, links[d]) for d in sets}
    assert {(r.doc_id, r.class_id) for r in got} == {(d, find(d)) for d in sets}


def test_phrases(docs, texts):
    seen, want = {}, set()
    words = {d: t.encode().split() for d, t in texts}
    for d, w in words.items():
        for s in range(len(w) - 19):
            seen.setdefault(tuple(w[s : s + 20]), (d, s))
    for d, w in words.items():
        cover = {j for s in range(len(w) - 19) if seen[tuple(w[s : s + 20])] != (d, s) for j in range(s, s + 20)}
        left = b" ".join(x for j, x in enumerate(w) if j not in cover)
        want.add((d, len(w), len(cover), hashlib.sha256(left).hexdigest()))
    assert set(map(tuple, phrase_dedup.report(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == want
