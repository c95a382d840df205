"""Relevance score parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Points for name and size, and the size limits they apply to.
EXACT_POINTS, PREFIX_POINTS, CONTAINS_POINTS = 100, 50, 25
SMALL_POINTS, MEDIUM_POINTS = 10, 5
SMALL_BYTES, MEDIUM_BYTES = 1024, 1024 * 1024


def score_name(
    name: Column, query: Column, prefer_exact: bool = True, case_sensitive: Column | bool = False
) -> Column:
    """100 for the very name, 50 for its beginning, 25 for a part of it, else 0."""
    if isinstance(case_sensitive, Column):
        text = F.when(case_sensitive, name).otherwise(F.lower(name))
        wanted = F.when(case_sensitive, query).otherwise(F.lower(query))
    elif case_sensitive:
        text, wanted = name, query
    else:
        text, wanted = F.lower(name), F.lower(query)
    points = F.when(text == wanted, EXACT_POINTS)
    if prefer_exact:
        points = points.when(F.startswith(text, wanted), PREFIX_POINTS)
    return points.when(F.contains(text, wanted), CONTAINS_POINTS).otherwise(0)


def score_size(size: Column) -> Column:
    return F.when(size < SMALL_BYTES, SMALL_POINTS).when(size < MEDIUM_BYTES, MEDIUM_POINTS).otherwise(0)


def score_recency(modified_time: Column) -> Column:
    """Age carries no points."""
    return F.lit(0)
