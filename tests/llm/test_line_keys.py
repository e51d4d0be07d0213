"""Keys of words by pairs of bytes against one byte at a time, and meetings that are dropped before they are unpacked."""

import random

import numpy as np
import pyarrow as pa

from threadloom.llm import hashing, line_dedup


def test_keys_by_pairs_equal_keys_by_bytes():
    r = random.Random(3)
    assert len(hashing._PAIR) == 1 << 16
    for _ in range(100):
        texts = [bytes(r.choice(b"ab \n\t\x0bcd\xc3\xa9\x00") for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 6))]
        keys, line = hashing.line_words(texts)
        want = []
        for number, own in enumerate(b"\n".join(texts).split(b"\n")):
            for word in own.split():
                value = sum(int(hashing._VALUE[b]) * pow(hashing.BASE, i, 1 << 64) for i, b in enumerate(word)) + len(word)
                want.append((int(hashing.mix(np.array([value % (1 << 64)], dtype=np.uint64))[0]), number))
        assert list(zip(keys.tolist(), line.tolist(), strict=True)) == want


def test_unwanted_meetings_are_not_unpacked():
    rows = np.zeros(50, dtype=line_dedup.RECORD)
    rows["meet"], rows["node"] = np.arange(50), np.arange(50)
    batch = line_dedup._dealt(rows, np.zeros(50, bool), 4)
    whole = line_dedup._records(batch)
    keep = np.zeros(1 << (line_dedup.BITMAP_BITS - 3), dtype=np.uint8)
    at = int(whole["meet"].view(np.uint64)[7] >> np.uint64(64 - line_dedup.BITMAP_BITS))
    keep[at >> 3] |= 1 << (at & 7)
    some = line_dedup._records(batch, keep)
    assert len(some["node"]) == 1 and all(some[c][0] == whole[c][7] for c in whole)
    assert isinstance(batch, pa.RecordBatch)
