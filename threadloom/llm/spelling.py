"""Spelling variant grouping by full neighbourhood generation.

Every vocabulary word emits all distinct strings one edit away: deletions, replacements and insertions over the letters that the
vocabulary itself holds. A candidate that equals a vocabulary word is a near word, so a hash join on the string decides and no distance
is ever computed. Candidates are hashed from prefix and suffix sums without being built; only those that a Bloom filter of the
vocabulary lets through become strings and are shuffled. The filter has a fixed size: a vocabulary of more than WORDS_A_PASS words is
met in several passes, each with the filter of its own slice of the words, so what is broadcast never grows.

Each word then takes the most frequent near word as its form if that is at least RATIO times as frequent, and forms are followed to
their ends by pointer doubling (frequencies double along a chain, so chains are short and without cycles).

Defined results: a null or empty text has no runs; repeated rows count each; a null ``doc_id`` enters the hash of a run as an empty
string; a run of any length is one word, and positions of a very long word are hashed in blocks; ties between forms go to the smaller
word in code-point order; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import documents, materialise, parts_for
from threadloom.llm.hashing import BASE, INVERSE, mix, power

#: Letters of a run, as a pattern's class; all of them are single bytes in Latin-1.
LETTERS = r"a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: A run whose hash this divides loses one letter.
DROP_EVERY = 97
FILTER_BITS, PROBES = 27, 4
WORDS_A_PASS = 1 << 23
#: Candidate keys that a task holds at a time.
BLOCK = 1 << 20
_SALTS = np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(BASE)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(7))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of the runs of letters, some with a letter dropped, of at least ``least_length`` letters and ``least_count`` occurrences."""
    runs = F.regexp_extract_all(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    # a shorter run yields no word, dropped letter or not, so the pattern passes over it
    each = documents(docs).select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("head"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("head", "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    dropped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % DROP_EVERY == 0, dropped).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters in a row, and the lengths."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8), np.array([len(w) for w in words], dtype=np.int64)


def _sums(code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every letter: its place in its word, its term, the sum before it and its word's sum."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(code)) - first
    term = _LETTER[code] * power(BASE, int(sizes.max()) + 1)[place]
    before = np.r_[np.zeros(1, np.uint64), np.cumsum(term)]
    whole = np.repeat(np.diff(before[np.r_[0, np.cumsum(sizes)]]), sizes)
    return place, term, before[:-1] - before[first], whole


def _finish(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_keys(words: list[str]) -> np.ndarray:
    code, sizes = _flat(words)
    ends = np.cumsum(sizes)
    return _finish(_sums(code, sizes)[3][ends - 1], sizes)


def neighbours(words: list[str], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of every distinct string one edit from each word, in blocks: key, word, place and edit.

    An edit is 0 to 255 for that letter put in before the place, 256 and up for it put in the place's stead, -1 for the place left out.
    Leaving out only the first of equal neighbours, and putting no letter behind its own like, names each string once.
    """
    code, sizes = _flat(words)
    place, term, before, whole = _sums(code, sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    size = sizes[word]
    powers = power(BASE, int(sizes.max()) + 2)
    values = _LETTER[letters]
    previous = np.where(place > 0, np.r_[np.uint8(0), code[:-1]], 0)  # 0 is no letter of a run
    step = max(1, BLOCK // (len(letters) + 1))
    for lo in range(0, len(code), step):
        own = slice(lo, lo + step)
        c, p, t, b, w, n, k = code[own], place[own], term[own], before[own], whole[own], size[own], word[own]
        keep = np.flatnonzero(previous[own] != c)
        yield _finish(b + (w - b - t) * np.uint64(INVERSE), n - 1)[keep], k[keep], p[keep], np.full(len(keep), -1)
        at = powers[p][:, None]
        i, j = np.nonzero(letters[None, :] != c[:, None])
        yield _finish((w - t)[:, None] + values * at, n[:, None])[i, j], k[i], p[i], letters[j].astype(np.int64) + 256
        i, j = np.nonzero(letters[None, :] != previous[own][:, None])
        yield _finish((b + (w - b) * np.uint64(BASE))[:, None] + values * at, n[:, None] + 1)[i, j], k[i], p[i], letters[j].astype(np.int64)
    last = np.cumsum(sizes) - 1
    for lo in range(0, len(words), step):  # behind the last letter
        k = np.arange(lo, min(lo + step, len(words)))
        i, j = np.nonzero(letters[None, :] != code[last[k]][:, None])
        yield _finish(whole[last[k]][:, None] + values * powers[sizes[k]][:, None], sizes[k][:, None] + 1)[i, j], k[i], sizes[k][i], letters[j].astype(np.int64)


def edited(word: str, place: int, edit: int) -> str:
    if edit < 0:
        return word[:place] + word[place + 1 :]
    return word[:place] + chr(edit & 255) + word[place + (edit >> 8) :]


def _probe(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The ``k``-th place of each key in a filter."""
    return (mix(keys + _SALTS[k]) >> np.uint64(64 - bits)).astype(np.int64)


def bloom(words: DataFrame, passes: int, turn: int, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter of one slice of the vocabulary: 2**bits bits, whatever the vocabulary."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = word_keys(batch["word"].to_pylist())
                own = keys[keys % np.uint64(passes) == turn]
                at = np.concatenate([_probe(own, k, bits) for k in range(PROBES)])
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["at", "bit"])

    got = words.select("word").mapInArrow(emit, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), dtype="<i8")
    out[np.asarray(got["at"])] = np.asarray(got["bits"])
    return out.view(np.uint8)


def near_words(words: DataFrame, words_a_pass: int = WORDS_A_PASS, bits: int = FILTER_BITS) -> DataFrame:
    """``word``, ``n_near`` and its most frequent near word (``near``, ``near_n``), for strings that a vocabulary word (``word``, ``n``) is
    one edit away from; of these, the vocabulary's own are its near words."""
    spark = words.sparkSession
    count = words.count()
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # 90 letters at most
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), dtype=np.uint8)
    passes, found = parts_for(count, words_a_pass, 1), None
    for turn in range(passes):
        held = spark.sparkContext.broadcast(bloom(words, passes, turn, bits))

        def emit(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, n = batch["word"].to_pylist(), np.asarray(batch["n"])
                for keys, word, place, edit in neighbours(own, alphabet):
                    live = np.flatnonzero(keys % np.uint64(passes) == turn) if passes > 1 else np.arange(len(keys))
                    for k in range(PROBES):
                        at = _probe(keys[live], k, bits)
                        live = live[(held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                    if len(live):
                        w = word[live]
                        built = [edited(own[i], p, e) for i, p, e in zip(w.tolist(), place[live].tolist(), edit[live].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(built, pa.string()), batch["word"].take(pa.array(w)), pa.array(n[w])], names=["word", "near", "n"])

        part = words.repartition(parts_for(count, 4096, 1), "word").mapInArrow(emit, "word string, near string, n long")
        best = part.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near"))).alias("best"))
        best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
        found = best if found is None else found.unionByName(best)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for words that have a form: pointers (``word``, ``form``) are doubled until all reach a word without one."""
    state = forms.select("word", F.col("form").alias("to"), F.lit(False).alias("ended"))
    while True:
        on = state.where("not ended").select(F.col("word").alias("from"), F.col("to").alias("next"))
        # a word that itself still moves hands on its own pointer; one that has ended hands on its end
        ends = state.where("ended").select(F.col("word").alias("from"), F.col("to").alias("next"))
        moving = state.where("not ended").join(on.withColumn("last", F.lit(False)).unionByName(ends.withColumn("last", F.lit(True))), F.col("to") == F.col("from"), "left")
        moved = moving.select("word", F.coalesce("next", "to").alias("to"), (F.col("next").isNull() | F.col("last")).alias("ended"))
        state = materialise(moved.unionByName(state.where("ended")), "roots")
        if state.where("not ended").isEmpty():
            return state.select("word", F.col("to").alias("root"))


def report(docs: DataFrame, words_a_pass: int = WORDS_A_PASS, bits: int = FILTER_BITS) -> DataFrame:
    words = materialise(vocabulary(docs), "vocabulary")
    joined = words.join(near_words(words, words_a_pass, bits), "word", "left")
    has = F.col("near_n") >= RATIO * F.col("n")
    known = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(known.where("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
