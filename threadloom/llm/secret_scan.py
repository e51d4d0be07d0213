r"""Secret scans: base patterns, and windowed Shannon entropy over candidate strings; SQL functions only.

Base spans are leftmost non-overlapping matches of three patterns. A candidate is a run of 20 or more token
characters; it belongs to the narrowest class that holds it (hex, alnum, base64), and a window of 20 characters slides
over it. The window's counts are kept per character of the word and changed by one for the character that enters and the one
that leaves, in time proportional to the word's length, and with them the sum of ``n log2 n`` from which the entropy follows. A candidate whose best window
reaches its class's threshold is a span of kind ``entropy``, unless an allow-list pattern matches it or a base span
overlaps it.

Defined results: a null or empty text has no spans (``spans`` is empty, ``base_sha256`` that of the empty string);
repeated rows are scanned each; texts and candidates of any length are scanned whole; any other columns, whatever their names, are
ignored. One narrow pass: no shuffle, one output row an input row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import documents

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
#: A cheap test that a text can hold an assignment at all.
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character in the best window, by class of the candidate.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.85}
#: Never secrets: letters only, one repeated character, UUIDs, placeholders, paths of plain words.
ALLOWED = (
    r"^[A-Za-z]+$",
    r"^(.)\1*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)(example|sample|placeholder|changeme|dummy|xxxx|0{8}|1234567)",
    r"^[A-Za-z]++([/_=-]++[A-Za-z]++)*+[/_=-]*$",  # possessive: no stack for a long path
)
SPAN = "array<struct<start:int,rank:int,end:int>>"


def located(text: Column, pattern: str, rank: int, hint: str, group: int = 0, least: int = 0) -> Column:
    """Spans in code points of the pattern's matches whose ``group`` has ``least`` characters; texts without a hint are skipped."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(found)), F.arrays_zip(found.alias("wide"), parts.alias("part")), lambda gap, m: F.struct(gap.alias("gap"), m["wide"].alias("wide"), F.length(m["part"]).alias("part"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    walk = F.aggregate(
        steps,
        start,
        lambda state, s: F.struct(
            (state["at"] + s["gap"] + s["wide"]).alias("at"),
            F.when(
                s["part"] >= least,
                F.concat(state["out"], F.array(F.struct((state["at"] + s["gap"]).alias("start"), F.lit(rank).alias("rank"), (state["at"] + s["gap"] + s["wide"]).alias("end")))),
            )
            .otherwise(state["out"])
            .alias("out"),
        ),
        lambda state: state["out"],
    )
    return F.when(text.rlike(hint), walk).otherwise(F.array().cast(SPAN))


def _weigh(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable is bound, an expression would be written out at every mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def best_window_entropy(word: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of any ``window`` consecutive characters.

    The word becomes numbers of its distinct letters once; each step then touches one count for the letter that enters and one for the
    letter that leaves, in time proportional to the letters' number, whatever the length of the word.
    """
    bits = float(window)

    def numbers(letters: Column) -> Column:
        return held(F.array_distinct(letters), lambda alphabet: F.struct(F.transform(letters, lambda c: F.array_position(alphabet, c).cast("int")).alias("code"), F.transform(alphabet, lambda _: F.lit(0)).alias("zero")))

    def walk(word: Column) -> Column:
        code = word["code"]

        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.element_at(code, i), F.when(i > window, F.element_at(code, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            gone = F.when(leaves > 0, F.element_at(state["counts"], F.greatest(leaves, F.lit(1)))).otherwise(F.lit(0))
            had = F.element_at(state["counts"], enters) - F.when(enters == leaves, 1).otherwise(0)
            total = state["total"] - _weigh(gone) + _weigh(gone - 1) - _weigh(had) + _weigh(had + 1)
            changed = held(F.struct(enters.alias("enters"), leaves.alias("leaves")), lambda e: F.transform(state["counts"], lambda n, j: n + F.when(j + 1 == e["enters"], 1).otherwise(0) - F.when(j + 1 == e["leaves"], 1).otherwise(0)))
            return held(total, lambda t: F.struct(changed.alias("counts"), t.alias("total"), F.when(i >= window, F.greatest(state["best"], F.log2(F.lit(bits)) - t / bits)).otherwise(state["best"]).alias("best")))

        start = F.struct(word["zero"].alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(code)), start, step, lambda state: state["best"])

    return F.when(F.length(word) > 0, held(held(F.split(word, ""), numbers), walk)).otherwise(F.lit(0.0))


def _suspicious(word: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    least = (
        F.when(word.rlike(r"^[0-9a-fA-F]+$"), THRESHOLDS["hex"])
        .when(word.rlike(r"^[A-Za-z0-9]+$"), THRESHOLDS["alnum"])
        .otherwise(THRESHOLDS["base64"])
    )
    return F.when(allowed, F.lit(False)).otherwise(best_window_entropy(word) >= least)


def entropy_spans(text: Column, base: Column) -> Column:
    """Candidates over their threshold that no base span overlaps."""
    spans = located(text, CANDIDATE, KINDS.index("entropy"), CANDIDATE)
    words = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))  # beside their spans, so that no word is cut out of the text again
    both = F.zip_with(spans, words, lambda s, w: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), w.alias("word")))
    free = held(base, lambda known: F.filter(both, lambda s: ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    return F.transform(F.filter(free, lambda s: _suspicious(s["word"])), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and arrays of spans (start, rank in KINDS, end): ``base`` and ``extra``."""
    text = F.col("text")
    base = (
        documents(docs)
        .withColumn("assign", located(text, ASSIGN, 0, ASSIGN_HINT, group=2, least=8))
        .withColumn("access", located(text, ACCESS, 1, ACCESS))
        .withColumn("hex", located(text, HEX, 2, HEX))
        .withColumn("base", F.concat("assign", "access", "hex"))
    )
    return base.select("doc_id", "assign", "access", "hex", "base", entropy_spans(text, F.col("base")).alias("extra"))


def report(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "extra")).alias("spans"),
    )
