"""Words of identifiers, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_words(name: Column) -> Column:
    """Lower-case words of an identifier: cut at camel humps and at anything but letters and digits."""
    humps = F.regexp_replace(F.regexp_replace(name, "([A-Z])([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(humps), "[^a-z0-9]+"), lambda w: w != "")


def holds_all(words: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), words)) == 0 if wanted else F.lit(False)


def shares_any(words: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)
