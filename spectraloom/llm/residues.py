"""The residues of a peptide as reported, and pieces of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def residues(peptide: Column) -> Column:
    """``peptide`` trimmed, without flanks ``X.`` ... ``.X``, upper-cased, only A-Z kept; null stays null."""
    text = F.regexp_replace(peptide, r"^\s+|\s+$", "")
    core = F.regexp_replace(text, r"^[A-Za-z\-]\.(.*)\.[A-Za-z\-]$", "$1")
    return F.regexp_replace(F.upper(core), "[^A-Z]", "")


def pieces(text: Column, k: int) -> Column:
    """The set of substrings of length ``k``; empty for shorter or null text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1)))
    found = F.array_distinct(F.transform(starts, lambda at: F.substr(text, at, F.lit(k))))
    return F.when(F.length(text) >= k, found).otherwise(F.array().cast("array<string>"))
