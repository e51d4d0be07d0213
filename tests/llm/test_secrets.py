"""Secret scans against a plain scan, and in linear time for long candidates."""

import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.llm import secret_scan

SF = "/root/testdata/sf0.01"
LETTERS = string.ascii_letters + string.digits + "+/"
ALLOWED = [
    lambda w: w.isalpha(), lambda w: len(set(w)) == 1, lambda w: re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", w),
    lambda w: any(x in w.lower() for x in ("example", "sample", "placeholder", "changeme", "dummy", "xxxx", "00000000", "1234567")),
    lambda w: w[0].isalpha() and all(c.isalpha() or c in "/_=-" for c in w),
]


def entropy(word):
    best = 0.0
    for i in range(len(word) - 19):
        n = Counter(word[i : i + 20]).values()
        best = max(best, math.log2(20) - sum(x * math.log2(x) for x in n) / 20)
    return best


def plain(text):
    text = text or ""
    found = [("assign", m.span()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    found += [("access", m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    extra = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        w = m[0]
        least = 3.0 if re.fullmatch("[0-9a-fA-F]+", w) else 3.7 if w.isalnum() else 3.85
        if not any(a < m.end() and m.start() < b for _, (a, b) in found) and not any(f(w) for f in ALLOWED) and entropy(w) >= least - 1e-12:
            extra.append(("entropy", m.span()))
    order = ("assign", "access", "hex", "entropy")
    spell = lambda spans: ",".join(f"{k}:{a}:{b}" for k, (a, b) in sorted(spans, key=lambda s: (s[1][0], order.index(s[0]))))
    n = Counter(k for k, _ in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(spell(found).encode()).hexdigest(), spell(found + extra)


COLUMNS = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def test_equals_a_plain_scan_of_all_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: tuple(r)[1:] for r in secret_scan.report(spark.read.parquet(f"{SF}/documents.parquet")).select(*COLUMNS).collect()}
    assert got == {d: plain(t) for d, t in rows}
    assert any(v[0] for v in got.values())  # the table holds assignments only


def test_odd_rows(spark):
    r = random.Random(1)
    word = lambda n, letters=LETTERS: "".join(r.choice(letters) for _ in range(n))
    texts = [
        None, "", " ", "a" * 50, "ab" * 30, word(20), word(19), word(21), word(400), f"é😀 {word(30)} ü", f"token={word(40)} {word(40)}", "AKIA" + "A1" * 6, "AKIA" + "B" * 11,
        word(31, "0123456789abcdef"), word(32, "0123456789abcdef"), word(40, "0123456789ABCDEF"), "PassWord : 'abcdefgh'", "passwd=short", "api_key=" + "x" * 8, "path/to/some/plain/words/here", "123e4567-e89b-12d3-a456-426614174000",
        "my-example-" + word(30), word(25) + "\n" + word(25), "token=token=token=abcdefgh",
    ]
    rows = [*enumerate(texts), (5, texts[5]), (None, word(30))]
    clash = [F.lit("x").alias(c) for c in ("assign", "access", "hex", "base", "extra", "spans", "word")]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("*", *clash).repartition(3)
    got = [tuple(x) for x in secret_scan.report(table).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(((d, *plain(t)) for d, t in rows), key=str)


@pytest.mark.parametrize("text", ["".join(random.Random(2).choice(LETTERS) for _ in range(100_000)), "a-" * 60_000, " ".join("".join(random.Random(i).choice(LETTERS) for _ in range(30)) for i in range(2_000))])
def test_long_candidates_take_linear_time(spark, text):
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secret_scan.report(table.select("doc_id", F.substring("text", 1, 100).alias("text"))).collect()
    began = time.time()
    (row,) = secret_scan.report(table).select(*COLUMNS).collect()
    assert time.time() - began < 10
    assert tuple(row)[1:] == plain(text)
