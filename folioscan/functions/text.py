"""Scalar text functions as Column expressions (JVM-side unless said otherwise)."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as text handling in Python sees it: Unicode's, and the four separator controls.
SPACE = r"[\s\x{1c}-\x{1f}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end (``trim`` would take U+0020 only)."""
    return F.regexp_replace(col(c), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def full(c: Column | str) -> Column:
    """Null for an empty string, so that ``coalesce`` falls through on it."""
    return F.nullif(col(c), F.lit(""))


def clean_title(c: Column | str) -> Column:
    """Stripped; empty for null."""
    return strip(F.coalesce(col(c), F.lit("")))


def normalize_title(c: Column | str) -> Column:
    """Runs of white space to one space, stripped, lower case; empty for null."""
    return F.lower(strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"(?U){SPACE}+", " ")))


def normalize_identifier(c: Column | str) -> Column:
    """Lower case, stripped; empty for null."""
    return strip(F.lower(F.coalesce(col(c), F.lit(""))))


def year_of(c: Column | str) -> Column:
    """The first all-digit piece between hyphens, as int; null if there is none or it is too large."""
    digits = F.filter(F.split(col(c), "-"), lambda x: x.rlike("^[0-9]+$"))
    return F.get(digits, F.lit(0)).try_cast("int")


def joined(*parts: Column, by: str = "\n") -> Column:
    """Non-empty parts joined."""
    return F.concat_ws(by, *(full(p) for p in parts))


def library_text(title="title", abstract="abstract", creators="creators", tags="tags") -> Column:
    """What of a library item is embedded."""
    return joined(col(title), col(abstract), F.array_join(col(creators), "; "), F.array_join(col(tags), "; "))


def candidate_text(title="title", abstract="abstract", authors="authors") -> Column:
    """What of a candidate is embedded."""
    return joined(col(title), col(abstract), F.array_join(col(authors), "; "))


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the non-empty parts on end, without separators."""
    return F.sha2(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), 256)


def item_hash(title="title", abstract="abstract", creators="creators", tags="tags") -> Column:
    return content_hash(col(title), col(abstract), F.array_join(col(creators), ","), F.array_join(col(tags), ","))


@F.pandas_udf(T.StringType())
def unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references resolved (no built-in knows the named ones); Arrow batches, only rows with an ampersand are touched."""
    for s in parts:
        hit = s.str.contains("&", regex=False, na=False)
        s = s.copy()
        s[hit] = s[hit].map(html.unescape)
        yield s


def clean_abstract(c: Column | str) -> Column:
    """References resolved first, then tags to spaces, white space collapsed; null if nothing is left."""
    text = F.regexp_replace(unescape(col(c)), r"<[^>]+>", " ")
    return full(strip(F.regexp_replace(text, rf"(?U){SPACE}+", " ")))


def inverted_abstract(index: Column | str) -> Column:
    """Text of a map word -> places: gaps are skipped, of words at one place the later one in the map counts."""
    entries = F.map_entries(col(index))
    placed = F.flatten(F.transform(entries, lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("place"), i.alias("turn"), e["key"].alias("word")))))
    placed = F.array_sort(F.filter(placed, lambda x: x["place"] >= 0))
    last = F.filter(placed, lambda x, i: F.coalesce(F.get(placed, i + 1)["place"] != x["place"], F.lit(True)))
    return full(strip(F.array_join(F.filter(F.transform(last, lambda x: x["word"]), lambda w: w != ""), " ")))


def openalex_abstract(text: Column, index: Column) -> Column:
    """The given text if not blank, else the text of the inverted index."""
    return F.coalesce(full(strip(text)), inverted_abstract(index))


def shorten_values(m: Column | str, most: int = 80) -> Column:
    """Map values cut to ``most`` characters and an ellipsis."""
    return F.transform_values(col(m), lambda k, v: F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("…"))).otherwise(v))


def sorted_json(*columns: str) -> Column:
    """A JSON object with its keys in order, nulls left out."""
    return F.to_json(F.struct(*sorted(columns)))
