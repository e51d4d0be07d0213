"""Term weights and factors against dense numpy, measures against hand-worked values."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from threadloom.operators import topics

COUNTS, SEEDS = (2, 4), (17, 29)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    themes = [[f"{c}{i:02d}x" for i in range(12)] for c in "abcd"]
    out = [" ".join(r.choice(themes[k % 4] if r.random() < 0.85 else ["und", "the", "Straße", "x"]) for _ in range(r.randint(8, 40))) for k in range(120)]
    return out + ["", "x y z", "Only Strange Words", out[3], "a00x! A00X, a00x"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "doc long, body string").repartition(3)


def plain_table(texts):
    terms = []
    for t in texts:
        w = [x for x in re.findall(r"\w+", (t or "").lower()) if len(x) >= 2]
        terms.append(Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))
    n, df, tf = len(texts), Counter(), Counter()
    for c in terms:
        df.update(c.keys())
        tf.update(c)
    names = sorted(sorted((t for t in df if 5 <= df[t] <= 0.98 * n), key=lambda t: (-tf[t], t))[:5000])
    x = np.zeros((n, len(names)))
    for i, c in enumerate(terms):
        for j, t in enumerate(names):
            if c[t]:
                x[i, j] = (1 + math.log(c[t])) * (math.log((1 + n) / (1 + df[t])) + 1)
    norm = np.sqrt((x * x).sum(axis=1))
    return names, x[norm > 0] / norm[norm > 0][:, None], np.flatnonzero(norm > 0)


@pytest.fixture(scope="module")
def fitted(docs):
    return topics.topic_models(docs, "doc", "body", counts=COUNTS, seeds=SEEDS)


def test_terms_and_weights(docs, texts):
    names, x, rows = plain_table([*texts, None])
    terms = topics.vocabulary(docs, "body")
    got = {r.term: r.at for r in terms.collect()}
    assert got == {t: i for i, t in enumerate(names)}
    entries = topics.weighted_terms(docs, "doc", "body", terms).collect()
    assert sorted(r.doc for r in entries) == rows.tolist()
    for r in entries:
        dense = np.zeros(len(names))
        dense[r["at"]] = r.x
        assert dense == pytest.approx(x[rows.tolist().index(r.doc)])


def test_factors_equal_dense_ones_and_losses_fall(docs, texts, monkeypatch):
    monkeypatch.setattr(topics, "STEP", 50)
    names, x, rows = plain_table([*texts, None])
    entries = topics.weighted_terms(docs, "doc", "body", topics.vocabulary(docs, "body"))
    models, state, trace = topics.fit(entries, "doc", len(names), COUNTS, SEEDS)
    held = {r.doc: r.w for r in state.collect()}
    for i, (k, seed) in enumerate(models.grid):
        h = np.random.default_rng([seed, k]).random((k, len(names))) * 2 * np.sqrt(x.mean() / k)
        w = np.full((len(x), k), 1 / sum(k for k, _ in models.grid))
        for turn, seen in enumerate(trace):
            for _ in range(10):
                w = w * (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
            assert ((x - w @ h) ** 2).sum() == pytest.approx(seen[i], rel=1e-6)
            if turn + 1 < len(trace):
                assert trace[turn + 1][i] <= seen[i] + 1e-9
                for _ in range(10):
                    h = h * (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        assert models.h[models.slices[i]] == pytest.approx(h, rel=1e-5, abs=1e-9)
        assert np.array([held[d][models.slices[i]] for d in rows.tolist()]) == pytest.approx(w, rel=1e-5, abs=1e-9)


def test_measures_and_choice(fitted, texts):
    state, chosen, models = fitted
    names, x, _ = plain_table([*texts, None])
    tops = topics.top_terms(models, names)
    seen = x > 0
    for i, row in enumerate(chosen.table):
        pairs = [np.mean([math.log(((seen[:, a] & seen[:, b]).sum() + 1) / max(seen[:, b].sum(), 1)) for m, a in enumerate(topic[:10]) for b in topic[m + 1 : 10]]) for topic in tops[i]]
        assert row[3] == pytest.approx(np.mean(pairs))
        assert row[4] == pytest.approx(len({t for p in tops[i] for t in p}) / (15 * row[0]))
    assert [r[8] for r in chosen.table].count(True) == 1 and chosen.table[chosen.model][0] == 4
    themes = [{t[0] for t in terms if len(t) == 4} for terms in chosen.terms]
    assert sorted(min(t) for t in themes) == list("abcd")  # each theme leads a topic
    best = topics.assigned(state, "doc", models).where(f"model = {chosen.model}").collect()
    assert len({r.topic for r in best}) == 4 and len(best) == len(x)


def test_alignment_and_scores():
    assert topics.alignment([[1, 2], [3, 4]], [[4, 3], [2, 1]]) == 1.0
    assert topics.alignment([], []) == 1.0 and topics.alignment([[1]], []) == 0.0
    assert topics.diversity([[1, 2], [1, 3]]) == 0.75
    rows = {6: {"error": 3.0, "coherence": -2.0, "diversity": 0.5, "stability": 0.4}, 8: {"error": 1.0, "coherence": -1.0, "diversity": 0.8, "stability": 0.9}, 10: {"error": 2.0, "coherence": -1.5, "diversity": 0.7, "stability": 0.6}}
    scores = topics.selection_scores(rows)
    assert scores[8] == pytest.approx(1.0) and scores[6] == pytest.approx(0.0) and scores[10] == pytest.approx(0.4 * 0.4 + 0.25 * 0.5 + 0.2 * 2 / 3 + 0.15 * 0.5)


def test_no_documents(docs):
    state, chosen, _ = topics.topic_models(docs.limit(0), "doc", "body", counts=COUNTS, seeds=SEEDS)
    assert state.count() == 0 and chosen.table == []


def test_words_of_odd_texts(spark):
    texts = ["", " ", "a", "Été à 3e", "x  yy\u00a0zz_1", "\n", "漢字 漢", "--ab--", "tail ", None, "ab\tcd"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).sortWithinPartitions("i").select(topics.plain(topics.F.col("t")).alias("text")).toArrow()
    want = [[w for w in re.findall(r"\w+", (t or "").lower()) if len(w) >= 2] for t in texts]
    for step in (1, 8, 1 << 20):
        got = [[] for _ in texts]
        for batch in rows.to_batches():
            for at, doc, words in topics._word_pieces(batch, step):
                for d, w in zip(doc.tolist(), words.to_pylist(), strict=True):
                    got[at.start + d].append(w)
        assert got == want


def test_rare_pairs_never_leave_a_task(docs, texts):
    n = docs.count()
    some = {r.term for r in topics.candidates(docs, "body", n, 5, 0.98, 10).collect()}
    named = [r.term for r in topics.vocabulary(docs, "body", most=10).collect()]
    tf, df = Counter(), Counter()
    for t in texts:
        w = [x for x in re.findall(r"\w+", t.lower()) if len(x) >= 2]
        own = [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]
        tf.update(own)
        df.update(set(own))
    assert named == sorted(sorted((t for t in df if 5 <= df[t] <= 0.98 * n), key=lambda t: (-tf[t], t))[:10])
    assert set(named) <= some and len(some) < len(tf) / 4
    assert topics.candidates(docs, "body", n, 5, 0.98, 5000) is None  # too few sure terms: all are counted


def test_passes_move_blocks_and_no_documents(spark, docs):
    terms = topics.vocabulary(docs, "body")
    entries = topics.weighted_terms(docs, "doc", "body", terms)
    state = topics.saved(topics.blocked(entries.coalesce(1), "doc", terms.count(), 6), "blocks")
    assert topics._blocks(state).count() == 1
    held = {r.doc: (r["at"], r.x) for r in topics.documents_of(topics._blocks(state), "doc", terms.count()).collect()}
    assert held == {r.doc: (r["at"], r.x) for r in entries.collect()}


def test_rows_of_a_key_are_one_document(spark, docs):
    terms = topics.vocabulary(docs, "body")
    word = terms.first()["term"]
    two = spark.createDataFrame([(1, word), (1, f"{word} {word}"), (None, word)], "doc long, body string")
    got = {r.doc: (r["at"], r.x) for r in topics.weighted_terms(two, "doc", "body", terms.where(topics.F.col("term") == word).withColumn("at", topics.F.lit(0))).collect()}
    assert got == {1: ([0], [1.0]), None: ([0], [1.0])}
