"""DOIs and identifiers as keys."""

from __future__ import annotations

from pyspark.sql import functions as F


def plain_doi(column):
    """A DOI without resolver, label, case, escapes and trailing points; null if there is none."""
    text = F.replace(F.lower(column), F.lit("%2f"), F.lit("/"))
    return F.nullif(F.rtrim(F.regexp_extract(text, r"(10\.\d{4,}/\S+)", 1), F.lit(".,;")), F.lit(""))


def plain_identifier(column):
    return F.nullif(F.regexp_replace(F.lower(column), r"(?U)^\s+|\s+$", ""), F.lit(""))
