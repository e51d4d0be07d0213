"""Unicode normal forms, folded headers and table values. Only texts beyond ASCII cross to Python, in Arrow batches; the rest stays JVM-side."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a series' country in a folded header, in order of precedence.
COUNTRIES = (
    ("NZ", r"new zealand|\bnz\b"),
    ("UK", r"united kingdom|vuong quoc anh|\buk\b"),
    ("AU", r"australia|(^|[^a-z])uc([^a-z]|$)|\bau\b"),
    ("IE", r"ireland|\bie\b"),
)
DATE_HEADERS = ("ngay", "day", "date", "week")


def _beyond_ascii(text: Column, f) -> Column:
    return f(F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), text))


def normal_form(text: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD of a text; null stays null."""

    @F.pandas_udf("string")
    def to_form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return F.coalesce(_beyond_ascii(text, to_form), text)


def folded_text(text: Column) -> Column:
    """NFKC, lower case, white space folded to single spaces."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).lower().split()), na_action="ignore")

    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D\x1C-\x20]+", " "))
    return F.coalesce(_beyond_ascii(text, fold), plain)


def text_hash(text: Column) -> Column:
    """md5 of the folded text, empty for an empty one."""
    folded = folded_text(text)
    return F.when(folded == "", "").otherwise(F.md5(folded))


def folded_header(text: Column) -> Column:
    """Lower case without marks: NFKD less its combining characters, no byte order mark, white space folded; null gives an empty text."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        bare = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x.replace("﻿", "").strip().lower()) if not unicodedata.combining(c))
        return s.map(lambda x: " ".join(bare(x).split()), na_action="ignore")

    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D\x1C-\x20]+", " "))
    return F.coalesce(_beyond_ascii(text, fold), plain, F.lit(""))


def country(header: Column) -> Column:
    """The country that a folded header names, null for none."""
    out = None
    for name, pattern in COUNTRIES:
        met = F.regexp_like(header, F.lit(pattern))
        out = F.when(met, name) if out is None else out.when(met, name)
    return out


def is_date_header(header: Column) -> Column:
    return header.isin(*DATE_HEADERS)


def trend_value(cell: Column) -> Column:
    """A cell as a number: one below a bound counts one half, percent signs and thousands separators go, anything else is null."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    return F.when(F.startswith(text, F.lit("<")), 0.5).otherwise(F.regexp_replace(text, "[%,]", "").try_cast("double"))
