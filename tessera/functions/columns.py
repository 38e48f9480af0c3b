"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 4) -> Column:
    """Rounds halves towards plus infinity; Spark's round() takes them away from zero."""
    scale = 10**places
    return F.floor(x * scale + 0.5) / scale


def rounded(x: Column, places: int = 6) -> Column:
    return F.round(x.cast("double"), places)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0 or null: missing is never zero."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def status(sample: Column, least: int, known: Column | None = None) -> Column:
    """available, insufficient_sample, or source_unavailable where nothing is known."""
    out = F.when(F.coalesce(sample, F.lit(0)) >= least, "available").otherwise("insufficient_sample")
    return out if known is None else F.when(~known, "source_unavailable").otherwise(out)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def content_hash(*columns: str) -> Column:
    """SHA-256 of columns as text; nulls count as empty and columns are kept apart."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def place_in(vocabulary: list[str], column: Column) -> Column:
    """Place of a value in a fixed order, from 1; after the last for others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, vocabulary)), column), F.lit(0)), F.lit(len(vocabulary) + 1))
