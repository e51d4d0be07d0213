"""Spelling variants against a plain neighbourhood search."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import spelling


def plain(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    letters, form, near = sorted(set("".join(n))), {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + x + w[i + k :] for i in range(len(w) + 1) for x in letters for k in (0, 1)}
        own = [x for x in edits - {w} if x in n]
        best = min(((-n[x], x) for x in own), default=(0, None))
        near[w], form[w] = len(own), best[1] if -best[0] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n}


ROWS = [
    (1, None), (2, ""), (3, "   \n"), (4, "Straße STRASSE straße Straße strasse strasse"), (5, "ÜBERALL überall Überall überall uberall uberall uberall"), (6, "abcde " * 9 + "abcdf " * 4 + "abcdfg " * 2 + "abcd " * 8),
    (7, "abcdfg bcdfg bcdfg bcdfg aabcde aabcde aabcde"), (8, "eeeee eeeeee eeeeee eeeee eeeee eeeeee eeeeeee"), (8, "eeeeeee eeeeeee tiess tiesa tiesb " * 3), (None, "tiesa tiesb tiess " * 4), (None, None),
    (9, ("z" * 3000 + " ") * 3 + ("z" * 2999 + " ") * 7), (10, "d'accord naïve naïve naïve naive naive naive naive naive naive x1yzabc"), *[(i, f"colour color colours w{i}x plaything") for i in range(20, 3020)],
]


@pytest.fixture(scope="module")
def docs(spark):
    clash = [F.lit("x").alias(c) for c in ("word", "n", "run", "head", "near", "best")]
    return spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *clash).repartition(3)


@pytest.mark.parametrize("words_a_pass, bits", [(spelling.WORDS_A_PASS, spelling.FILTER_BITS), (4, 8)])
def test_equals_a_plain_search(docs, words_a_pass, bits):
    """Also in many passes through a filter so small that it lets most through."""
    got = [tuple(r) for r in spelling.report(docs, words_a_pass, bits).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(ROWS)


def test_dropped_letters_are_met(docs):
    assert any(len(w) == 8 and w in {"plaything"[:i] + "plaything"[i + 1 :] for i in range(9)} for w, *_ in plain(ROWS))


def test_every_neighbour_is_named_once():
    letters = np.frombuffer("abcé".encode("latin-1"), dtype=np.uint8)
    for word in ("aabca", "é", "abccc"):
        found = [(k, spelling.edited(word, p, e)) for keys, _, places, edits in spelling.neighbours([word], letters) for k, p, e in zip(keys, places.tolist(), edits.tolist(), strict=True)]
        own = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + x + word[i + k :] for i in range(len(word) + 1) for x in "abcé" for k in (0, 1)}
        built = [w for _, w in found]
        assert sorted(built) == sorted(own - {word})
        assert all(k == spelling.word_keys([w])[0] for k, w in found if w)


def test_empty_table(docs):
    assert spelling.report(docs.limit(0)).count() == 0
