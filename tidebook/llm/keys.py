"""Keys of rows that may repeat or lack an id, and small text helpers in SQL functions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def text_key(text: Column) -> Column:
    """Digest that, with the id, names a row for results that depend on the text alone."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(41))


def attach(rows: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("doc_id", "key")) -> DataFrame:
    """Left join on null-safe keys; ``found`` has one row per key."""
    other = found.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in found.columns if c not in keys))
    same = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = term if same is None else same & term
    return rows.join(other, same, "left").drop(*(f"_{k}" for k in keys))
