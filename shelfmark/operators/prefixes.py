"""Prefix matching as an equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.text import for_value


def prefix_lengths(prefixes: DataFrame, column: str = "prefix") -> list[int]:
    """Distinct lengths in characters: at most one per position of the longest path."""
    rows = prefixes.select(F.char_length(column).alias("n")).distinct().collect()
    return sorted(row.n for row in rows)


def beginnings(column: str, lengths: list[int]) -> str:
    """SQL array of a text's first n characters, for every n that the text has."""
    numbers = f"CAST(array({', '.join(map(str, lengths))}) AS ARRAY<INT>)"
    fitting = f"filter({numbers}, n -> n <= char_length(t))"
    return for_value(column, f"transform({fitting}, n -> substring(t, 1, n))")


def with_prefixes(df: DataFrame, prefixes: DataFrame, column: str = "prefix") -> DataFrame:
    """One row per path and occurring prefix length, with the path's beginning as ``column``."""
    lengths = prefix_lengths(prefixes, column)
    return df.selectExpr("*", f"explode({beginnings('path', lengths)}) AS {column}")
