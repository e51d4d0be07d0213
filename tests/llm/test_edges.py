"""Clashing names, single labelled rows, split words, substitutions and plans beyond their bounds."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, line_dedup, near_join, quality_pu

NAMES = "row mark id its gone lines mask n node check size score kind best w at _id _mark _gone _score _text_mark _lines".split()


@pytest.fixture(scope="module")
def prose():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(500)]
    return lambda n: " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, prose):
    base = prose(60)
    rows = [(1, base), (2, base + " tail"), (3, None), (4, ""), (5, "x\n" + prose(12) + "\n" + base), (6, prose(3000)), (6, prose(3000)), (None, base), (7, base), (7, base)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])


def untouched(before, after):
    assert after.columns == before.columns
    assert all(r[c] == f"own {c}" for r in after.collect() for c in NAMES)


def test_filters_keep_columns_of_any_name(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (6, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "none of these words occur in any of the documents at all today")], "item_id long, text string")
    for after in (line_dedup.filtered(docs), near_join.keep_one(docs), quality_pu.keep_good(docs, labels, 0.0), decontaminate.decontaminate(docs, bench)):
        untouched(docs, after)
    assert quality_pu.keep_good(docs, labels, 0.0).count() == docs.count()
    kept = [(r.doc_id, r.text) for r in near_join.keep_one(docs).collect()]
    assert sorted(d for d, t in kept if t) == [1, 6, 6] or sorted(d for d, t in kept if t) == [1, 5, 6, 6]
    left = {r.doc_id: r.text for r in line_dedup.filtered(docs).collect() if r.doc_id not in (None, 6)}
    assert left[3] is None and left[4] == "" and 2 not in left and 7 not in left


@pytest.mark.parametrize("positives", [0, 1, 2])
def test_quality_of_few_labels(spark, docs, positives):
    labels = spark.createDataFrame([(d, 1) for d in (1, 6)[:positives]] + [(2, 0)], "doc_id long, quality int")
    got = quality_pu.report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert positives or {r.score for r in got} == {0.5}
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1


def test_split_words_change_nothing(spark, prose, monkeypatch):
    r = random.Random(4)
    common = [f"c{i}" for i in range(6)]
    lines = [" ".join([*r.sample(common, 4), *([f"z{i % 7}"] if i % 3 else [])]) for i in range(400)] + [prose(9) for _ in range(20)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.report(docs).collect()))
    for bound in (line_dedup.HOT_BOUND, 0):
        monkeypatch.setattr(line_dedup, "SPLIT_ROWS", 10)
        monkeypatch.setattr(line_dedup, "HOT_BOUND", bound)
        assert sorted(map(tuple, line_dedup.report(docs).collect())) == want


def test_copies_of_a_line_are_no_meetings(spark, monkeypatch):
    """A word whose rows are copies of few lines is neither split nor multiplied."""
    monkeypatch.setattr(line_dedup, "SPLIT_ROWS", 10)
    rows = [(7, 1 + k % 2, 3, 1000 - k, k % 5, 5, 0, 1) for k in range(500)] + [(8, k, 3, k, 0, 5, 0, 1) for k in range(25)] + [(9, 1, 3, 4, 0, 5, 0, 1), (9, 1, 3, 2, 1, 5, 0, 1)]
    table = spark.createDataFrame(rows, line_dedup.MEETING).repartition(50)
    got, many = line_dedup.common_meetings(lambda keep=None: table)
    kept = got.collect()
    assert len(kept) == many == 2 + 25 * 3 + 2
    assert sorted((r.node, r.doc, r.line) for r in kept if r.node < 3 and r.doc > 400) == [(1, 502, 3), (2, 501, 4)]


def test_every_two_substitutions_are_found(spark):
    item = [f"w{i}" for i in range(40)]
    rows = []
    for k, (i, j) in enumerate(itertools.combinations(range(13), 2)):
        passage = list(item[14:27])
        passage[i] = passage[j] = "other"
        rows.append((k, " ".join([f"a{k}", "b", *passage, "c", f"d{k}"])))
    three = list(item[14:27])
    three[0] = three[6] = three[12] = "other"
    rows += [(100, " ".join(three)), (101, " ".join(item[14:24])), (102, None), (103, "w " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.first_word) for r in decontaminate.report(docs, bench).collect()}  # a window may begin up to two words early
    assert [k for k in range(78) if not got[k][0] or got[k][1] not in (0, 1, 2)] == [] and not any(got[k][0] for k in range(100, 104))


def test_a_large_benchmark_is_joined_by_shuffle(spark, docs):
    texts = [r.text for r in docs.where("doc_id in (1, 6)").collect()]
    bench = spark.createDataFrame([(i, " ".join(t.split()[10:40])) for i, t in enumerate(texts)], "item_id long, text string")
    near = sorted(map(tuple, decontaminate.document_hits(docs, bench).distinct().collect()), key=str)
    far = sorted(map(tuple, decontaminate.document_hits(docs, bench, bound=0).distinct().collect()), key=str)
    assert near and near == far
