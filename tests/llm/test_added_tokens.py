"""Ids of texts that hold the vocabulary's added token, against the library as it is."""

import random

import numpy as np
from tokenizers import Tokenizer

from threadloom.llm import curve_pack, orc_tokens
from threadloom.llm.common import fresh_path
from threadloom.llm.tokens import default_vocabulary, encoder

VOCABULARY = default_vocabulary()
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext |>", "plain  text\n", ""]


def library(text):
    return Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    r = random.Random(3)
    letters = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "'s", "!", "\u3000", "\x85", "語", "<|endoftext|>", "<|", "endoftext", "|>"]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for s in TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(400)]:
        assert np.frombuffer(encoder(VOCABULARY).ids(s), dtype="<u2").tolist() == tokenizer.encode(s, add_special_tokens=False).ids, repr(s)
    assert library(TEXTS[0]) == [64, 220, 50256, 275]


def test_written_ids_equal_the_library(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    pieces = sorted((r.doc_id, r.start, bytes(r.ids)) for r in curve_pack.pack(docs, VOCABULARY).collect())
    packed = {d: np.frombuffer(b"".join(p for e, _, p in pieces if e == d), dtype="<u4").tolist() for d, _ in enumerate(TEXTS)}
    assert packed == {d: library(t) + [1] for d, t in enumerate(TEXTS)}
    path, at = fresh_path(spark, "test-added"), 0
    orc_tokens.write_tokens(docs, path, VOCABULARY)
    for r in orc_tokens.read_tokens(spark, path).orderBy("doc_id").collect():
        assert (r.start, list(r.ids)) == (at, library(TEXTS[r.doc_id]) + [0])
        at += r.n_tokens
