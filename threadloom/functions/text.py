"""Text scalars: presence, cleaning, masking, lexicon classes, digests. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"(?:https?://|www\.)[^\s]+"
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HANDLE = r"(^|[^A-Za-z0-9_])@[A-Za-z0-9_]{2,}"
PHONE = r"\+?[0-9][0-9 ()-]{7,}[0-9]"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_light(html: Column) -> Column:
    """Tags out, the five basic entities back, Markdown links to their anchors, blanks collapsed."""
    bare = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return collapse(F.regexp_replace(bare, r"\[([^\]]+)\]\([^)]+\)", "$1"))


def without_quotes(text: Column) -> Column:
    """Lines that begin with ``>`` removed."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.ltrim(line).startswith(">")), "\n")


def presence(*parts: Column) -> Column:
    """empty, deleted, removed or eligible, over all parts of a record."""
    whole = F.transform(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: F.lower(F.trim(p)))
    full = F.filter(whole, lambda p: p != "")
    return (
        F.when(F.size(full) == 0, "empty")
        .when(F.forall(full, lambda p: p == "[deleted]"), "deleted")
        .when(F.forall(full, lambda p: p.isin("[removed]", "[deleted]")), "removed")
        .otherwise("eligible")
    )


def masked(text: Column) -> Column:
    """Addresses, URLs, phone-like numbers and handles replaced by placeholders, in that order."""
    at = F.contains(text, F.lit("@"))
    out = F.when(at, F.regexp_replace(text, EMAIL, "<EMAIL>")).otherwise(text)
    out = F.regexp_replace(out, URL, "<URL>")
    out = F.regexp_replace(out, PHONE, "<PHONE>")
    return F.when(at, F.regexp_replace(out, HANDLE, "$1<USER>")).otherwise(out)


def mask_counts(text: Column) -> Column:
    emails = F.when(F.contains(text, F.lit("@")), F.regexp_count(text, F.lit(EMAIL))).otherwise(0)
    return F.struct(emails.alias("emails"), F.regexp_count(text, F.lit(URL)).alias("urls"), F.regexp_count(text, F.lit(PHONE)).alias("phones"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def has_term(text: Column, *terms: str) -> Column:
    """Any of the terms between non-alphanumerics, case folded: one pattern, however many terms."""
    return F.lower(text).rlike(rf"(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)")


def lexicon_groups(text: Column, groups: dict[str, list[str]], gate: str | None = None, context: list[str] | None = None) -> Column:
    """Names of the groups with a term in the text. With a gate, other groups count only if the gate group or a context term does; the
    gate is read only where such a group fires."""
    fires = {name: has_term(text, *terms) for name, terms in groups.items()}
    if gate:
        opened = has_term(text, *groups[gate], *(context or []))
        fires = {name: f if name == gate else f & opened for name, f in fires.items()}
    return F.array_compact(F.array(*[F.when(f, F.lit(name)) for name, f in fires.items()]))


def near_each_other(text: Column, a: str, b: str, within: int = 80) -> Column:
    """A match of ``a`` and one of ``b`` at most ``within`` characters apart, either first."""
    gap = f"[\\s\\S]{{0,{within}}}?"
    return F.lower(text).rlike(f"({a}){gap}({b})|({b}){gap}({a})")


def distinct_hits(text: Column, terms: list[str]) -> Column:
    """Terms found, longest first where they overlap, each once, sorted."""
    pattern = "|".join(sorted(terms, key=lambda t: (-len(t), t)))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(0))))


def digest_casefold(text: Column) -> Column:
    return F.sha2(F.lower(text), 256)


def duplicate_key(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), 256)


def phrase_exact(text: Column, phrase: Column) -> Column:
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.contains(F.concat(F.lit(" "), fold(text), F.lit(" ")), F.concat(F.lit(" "), fold(phrase), F.lit(" ")))


def all_terms(text: Column, query: Column) -> Column:
    return F.forall(words(query), lambda t: F.contains(F.lower(text), t))
