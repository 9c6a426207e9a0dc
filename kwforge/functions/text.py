"""Tokenizers as column expressions; each gives an array of keywords, duplicates kept, null text giving none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _words(text: Column, pattern: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda w: w != "")


def alphanumeric(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; any other character ends a keyword."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def delimited(text: Column) -> Column:
    """Split at white space, commas, tabs and semicolons; case is kept."""
    return _words(text, r"[\s,;]+")


def piped(text: Column) -> Column:
    """Split at commas, white space, semicolons and bars."""
    return _words(text, r"[,\s;|]+")


def quoted(text: Column) -> Column:
    """As delimited, with quotes taken away first."""
    return delimited(F.regexp_replace(text, "[\"']", ""))


TOKENIZERS = {"alphanumeric": alphanumeric, "delimited": delimited, "piped": piped, "quoted": quoted}
