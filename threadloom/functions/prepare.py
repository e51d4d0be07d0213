"""Preparation of records: languages, sentiment, tokens, views, identifiers. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words by language, for telling languages apart.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "that", "is", "for", "with"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "mit", "zu"],
    "fr": ["le", "la", "les", "et", "des", "une", "est", "que", "dans"],
    "es": ["el", "los", "que", "y", "las", "una", "del", "por", "con"],
}
#: Confidence below which a detection is uncertain, and the shortest text it holds for.
LEAST_CONFIDENCE, LEAST_CHARS = 0.80, 24
#: A detection overrules a declared language from this confidence and length on.
OVERRULE_CONFIDENCE, OVERRULE_CHARS = 0.999, 60
STOPWORDS = ["the", "and", "of", "to", "in", "that", "is", "for", "with", "a", "an", "it", "on", "as"]
#: Stopwords of other lists that carry meaning here and stay.
KEEPWORDS = ["not", "no", "nor", "never"]
#: Contractions of the sentiment view.
CONTRACTIONS = {"can't": "cannot", "won't": "will not", "n't": " not", "'re": " are", "'ll": " will", "'ve": " have"}
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"


def letters(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def language_hits(tokens: Column) -> Column:
    """Function words of each language in the text, as an array of (hits, order, language)."""
    many = lambda own: F.size(F.filter(tokens, lambda w: w.isin(own)))
    return F.array(*[F.struct(many(own).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("language")) for i, (name, own) in enumerate(FUNCTION_WORDS.items())])


def detected(hits: Column) -> tuple[Column, Column]:
    """The language with most function words (ties to the first named) and its share of all of them; null without any."""
    best = F.array_max(hits)
    total = F.aggregate(hits, F.lit(0), lambda a, h: a + h["hits"])
    return F.when(total > 0, best["language"]), F.when(total > 0, best["hits"] / total)


def uncertain(confidence: Column, chars: Column) -> Column:
    return confidence.isNull() | (confidence < LEAST_CONFIDENCE) | (chars < LEAST_CHARS)


def language_basis(declared: Column, found: Column, confidence: Column, chars: Column, home: str = "en") -> Column:
    """Why a text counts as in the home language or not. A detection overrules a declared tag only if nearly certain and long enough."""
    sure = (confidence >= OVERRULE_CONFIDENCE) & (chars >= OVERRULE_CHARS)
    tagged, seen = declared.isNotNull() & (declared != ""), found.isNotNull()
    return (
        F.when(chars == 0, "no_text")
        .when(tagged & (declared == home) & seen & (found == home), "declared_confirmed")
        .when(tagged & (declared == home) & seen & sure, "declared_overridden")
        .when(tagged & (declared == home), "declared")
        .when(tagged & seen & (found == home) & sure, "detected_override")
        .when(tagged, "declared_other")
        .when(seen & (found == home), "detected")
        .when(seen, "detected_other")
        .otherwise("undetectable")
    )


def topic_tokens(text: Column) -> Column:
    """Words of three letters or more without stopwords and numbers; negations stay."""
    return F.filter(letters(text), lambda w: ((F.length(w) >= 3) | w.isin(KEEPWORDS)) & ~w.isin(STOPWORDS))


def sentiment_view(text: Column) -> Column:
    """Contractions written out, addresses replaced by placeholders, blanks collapsed."""
    out = text
    for short, full in CONTRACTIONS.items():
        out = F.replace(out, F.lit(short), F.lit(full))
    out = F.regexp_replace(out, r"(?:https?://|www\.)[^ \t\n\r<>]+", "<URL>")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def without_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, "[​‌‍⁠﻿]", "")


def emoji_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(EMOJI))


def compound(score: Column) -> Column:
    """A valence sum squeezed into -1 .. 1."""
    return score / F.sqrt(score * score + 15)


def sentiment_label(c: Column, cut: float = 0.05) -> Column:
    return F.when(c >= cut, "positive").when(c <= -cut, "negative").otherwise("neutral")


def valence(tokens: Column, lexicon: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
    return F.aggregate(tokens, F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(table, w), F.lit(0.0)))


def guarded_hits(text: Column, terms: list[str]) -> Column:
    """Terms that occur between non-alphanumerics, in the order given; the text is folded once."""
    folded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    return F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(f" {t} ")), F.lit(t)) for t in terms]))


def channel_type(name: Column, rules: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """The first type of a priority list of which a term is in the name."""
    low, out = F.lower(name), None
    for kind, terms in rules:
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(low, F.lit(term))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(other)


def author_hash(salt: str, platform: str, ident: Column) -> Column:
    """A pseudonym of 16 hex digits; null and empty ids have an empty one."""
    whole = F.sha2(F.concat_ws("|", F.lit(salt), F.lit(platform), ident.cast("string")), 256)
    return F.when(ident.isNull() | (ident.cast("string") == ""), "").otherwise(F.substring(whole, 1, 16))


def typed_id(kind: str, ident: Column) -> Column:
    """``kind_id`` whatever prefix the id came with."""
    return F.concat(F.lit(kind + "_"), F.regexp_replace(ident.cast("string"), "^t[0-9]_", ""))


def url_host(url: Column) -> Column:
    """The host, lower case, without port, ``www.`` or ``m.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^(www|m)\.", "")


def utc_bound(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: The patterns of the masking shared by all exports, over Unicode letters, digits and blanks.
SHARED_URL = r"(?:https?://|www\.)[^\s<]+"
SHARED_EMAIL = r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?![\w.-])"
SHARED_PHONE = r"(?<![\w-])\+?[\d][\d().\s-]{7,}[\d](?![\w-])"
SHARED_HANDLE = r"(?<![\w@])@[A-Za-z0-9_][A-Za-z0-9_.-]*"
#: Digits that a phone number has at least, so that dates and prose stay.
PHONE_DIGITS = 9


def unicode_classes(pattern: str) -> str:
    r"""The pattern with its classes written out, as the JVM's ``\w``, ``\d`` and ``\s`` know ASCII alone; all stand inside brackets."""
    for short, full in ((r"\w", r"\p{L}\p{N}_"), (r"\d", r"\p{Nd}"), (r"\s", r"\s\x1c-\x1f\x85\p{Z}")):
        pattern = pattern.replace(short, full)
    return pattern


def shared_mask(text: Column) -> Column:
    """URLs, contact details and handles replaced; texts without a digit, ``@`` or URL mark skip the pattern for it.

    A run that looks like a phone number but has too few digits stays as a whole, and the search goes on behind it.
    """
    url, phone, handle = "(?iu)" + unicode_classes(SHARED_URL), unicode_classes(SHARED_PHONE), unicode_classes(SHARED_HANDLE)
    email = unicode_classes(SHARED_EMAIL).replace(")+(?!", ")++(?!")  # giving labels back never helps, and keeping them needs no stack
    out = F.coalesce(text, F.lit(""))
    out = F.when(F.contains(out, F.lit("://")) | F.contains(F.lower(out), F.lit("www.")), F.regexp_replace(out, url, "<URL>")).otherwise(out)
    out = F.when(F.contains(out, F.lit("@")), F.regexp_replace(out, email, "<PII>")).otherwise(out)
    digits = lambda x: F.length(F.regexp_replace(x, r"\P{Nd}", ""))
    masked = F.transform(F.regexp_extract_all(out, F.lit(phone), F.lit(0)), lambda x: F.when(digits(x) >= PHONE_DIGITS, "<PII>").otherwise(x))
    joined = F.array_join(F.zip_with(F.split(out, phone, -1), F.concat(masked, F.array(F.lit(""))), lambda between, found: F.concat(between, found)), "")
    out = F.when(out.rlike(r"\p{Nd}"), joined).otherwise(out)
    return F.when(F.contains(out, F.lit("@")), F.regexp_replace(out, handle, "@user")).otherwise(out)
