"""Searches over one catalog.

Each search is one narrow filter, written so that Parquet can test as much of it as it is able
to: path prefixes, exact paths, extensions and sizes are pushed into the scan, and on a catalog
saved in path order prefixes and exact paths also skip row groups. ``ordered=False`` leaves out
the final sort by path where the caller aggregates, joins or sorts again anyway.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions import regex
from shelfmark.functions.naming import dotted, stem_of
from shelfmark.functions.predicates import has_any_extension, matches_extension
from shelfmark.functions.text import like_literal, within_distance
from shelfmark.operators.rank import by_score, with_score
from shelfmark.plans.sizing import broadcast_if_small

# Fuzzy distance used when none is given, and its limits.
DEFAULT_FUZZY_DISTANCE, MIN_FUZZY_DISTANCE, MAX_FUZZY_DISTANCE = 2, 1, 5


def _by_path(df: DataFrame, ordered: bool) -> DataFrame:
    return df.orderBy("path") if ordered else df


def search_prefix(df: DataFrame, prefix: str, ordered: bool = True) -> DataFrame:
    """Rows whose full path starts with the text; ``''`` gives every row."""
    found = df.filter(F.col("path").startswith(prefix)) if prefix else df
    return _by_path(found, ordered)


def search_name(df: DataFrame, text: str, ordered: bool = True) -> DataFrame:
    """Rows whose name contains the text in any case; ``''`` gives no row."""
    if text == "":
        return df.filter(F.lit(False))
    return _by_path(df.filter(F.contains(F.lower("name"), F.lower(F.lit(text)))), ordered)


def search_extension(df: DataFrame, extension: str, ordered: bool = True) -> DataFrame:
    """Rows with the extension, directories included; ``''`` gives no row."""
    return search_extensions(df, [extension] if extension else [], ordered)


def files_by_extension(df: DataFrame, extension: str) -> DataFrame:
    """Like ``search_extension`` without directories; ``''`` gives every file."""
    return df.filter(~F.col("is_dir") & matches_extension(extension))


def search_extensions(df: DataFrame, extensions: list[str], ordered: bool = True) -> DataFrame:
    """Rows with any of the extensions: one scan, each row once."""
    wanted = sorted({dotted(e) for e in extensions if e})
    if not wanted:
        return df.filter(F.lit(False))
    return _by_path(df.filter(F.col("extension").isin(wanted)), ordered)


def _folded(column: str, case_sensitive: bool):
    return F.col(column) if case_sensitive else F.lower(column)


def _folded_literal(text: str, case_sensitive: bool):
    return F.lit(text) if case_sensitive else F.lower(F.lit(text))


def search_exact(
    df: DataFrame, name: str, case_sensitive: bool = False, ordered: bool = True
) -> DataFrame:
    wanted = _folded_literal(name, case_sensitive)
    return _by_path(df.filter(_folded("name", case_sensitive) == wanted), ordered)


def search_substring(
    df: DataFrame, text: str, case_sensitive: bool = False, ordered: bool = True
) -> DataFrame:
    if not case_sensitive:
        return search_name(df, text, ordered)
    return _by_path(df.filter(F.col("name").contains(text)), ordered)


def search_wildcard(
    df: DataFrame, pattern: str, case_sensitive: bool = False, ordered: bool = True
) -> DataFrame:
    """Whole-name match of ``*`` and ``?``. Both sides are folded unless case matters."""
    name = F.col("name")
    like = like_literal(pattern)
    return _by_path(df.filter(name.like(like) if case_sensitive else name.ilike(like)), ordered)


def spark_regex(df: DataFrame, pattern: str) -> str:
    """The pattern in Java's dialect; ``ValueError`` if it cannot be compiled or is not supported."""
    given = F.lit(pattern)
    probe = df.sparkSession.range(1).select(
        regex.to_java(given).alias("java"), regex.is_valid(given).alias("valid")
    ).first()
    if not probe.valid:
        raise ValueError(f"this regex cannot be used: {pattern}")
    return probe.java


def search_regex(df: DataFrame, pattern: str, ordered: bool = True) -> DataFrame:
    """Unanchored, case-sensitive regex on the name (write ``(?i)`` to fold case)."""
    return _by_path(df.filter(F.col("name").rlike(spark_regex(df, pattern))), ordered)


def search_fuzzy(
    df: DataFrame,
    text: str,
    distance: int = DEFAULT_FUZZY_DISTANCE,
    case_sensitive: bool = False,
    on: str = "name",
    ordered: bool = True,
) -> DataFrame:
    """Names within an edit distance (1 to 5) of the text; ``on='stem'`` leaves the extension out."""
    limit = max(MIN_FUZZY_DISTANCE, min(MAX_FUZZY_DISTANCE, distance))
    compared = stem_of(F.col("name")) if on == "stem" else F.col("name")
    if not case_sensitive:
        compared = F.lower(compared)
    matches = within_distance(compared, _folded_literal(text, case_sensitive), limit)
    return _by_path(df.filter(matches), ordered)


def get_by_path(df: DataFrame, path: str) -> DataFrame:
    return df.filter(F.col("path") == path)


def contains_path(df: DataFrame, path: str) -> DataFrame:
    """One row with one boolean; the scan stops at the first match."""
    found = get_by_path(df, path).select("path").limit(1)
    return found.agg((F.count(F.lit(1)) > 0).alias("found"))


def present_paths(df: DataFrame, asked: DataFrame) -> DataFrame:
    """The distinct asked paths that the catalog has.

    When they are few they filter the scan by broadcast and the catalog is not shuffled.
    """
    small = broadcast_if_small(asked)
    return df.select("path").join(asked if small is None else small, "path", "left_semi")


def contains_paths(df: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of ``paths`` whose path is in the catalog."""
    present = present_paths(df, paths.select("path").distinct())
    return paths.join(present, "path", "left_semi")


def all_files(df: DataFrame) -> DataFrame:
    return df.orderBy("path")


@dataclass(frozen=True)
class SearchSpec:
    """One parsed search. NULL bounds are open; an empty pattern means filters only."""

    type: str = "substring"
    pattern: str = ""
    case_sensitive: bool = False
    extensions: list[str] = field(default_factory=list)
    min_size: int | None = None
    max_size: int | None = None
    fuzzy_distance: int = DEFAULT_FUZZY_DISTANCE


def match_by_type(df: DataFrame, spec: SearchSpec) -> DataFrame:
    """Rows that match the pattern, without filters and order."""
    if spec.pattern == "":
        return df
    case = spec.case_sensitive
    if spec.type == "prefix":
        return search_prefix(df, spec.pattern, ordered=False)
    if spec.type == "exact":
        return search_exact(df, spec.pattern, case, ordered=False)
    if spec.type == "substring":
        return search_substring(df, spec.pattern, case, ordered=False)
    if spec.type == "wildcard":
        return search_wildcard(df, spec.pattern, case, ordered=False)
    if spec.type == "regex":
        return search_regex(df, spec.pattern, ordered=False)
    if spec.type == "fuzzy":
        return search_fuzzy(df, spec.pattern, spec.fuzzy_distance, case, ordered=False)
    raise ValueError(f"unknown query type: {spec.type}")


def search(df: DataFrame, spec: SearchSpec, k: int | None = None) -> DataFrame:
    """Match, filter, score and order in one plan; ``k`` turns the sort into a top-k."""
    found = match_by_type(df, spec)
    if spec.extensions:
        found = found.filter(has_any_extension(*spec.extensions))
    if spec.min_size is not None or spec.max_size is not None:
        found = found.filter(~F.col("is_dir"))
    if spec.min_size is not None:
        found = found.filter(F.col("size") >= spec.min_size)
    if spec.max_size is not None:
        found = found.filter(F.col("size") <= spec.max_size)
    if spec.pattern:
        found = with_score(found, spec.pattern, case_sensitive=spec.case_sensitive)
    else:
        found = found.withColumn("score", F.lit(0))
    found = found.orderBy(*by_score())
    return found if k is None else found.limit(k)


def search_text(df: DataFrame, text: str, k: int | None = None) -> DataFrame:
    """``search`` for one query text; a text that cannot be read raises ``ValueError``."""
    from shelfmark.operators.query_table import parse_queries

    given = df.sparkSession.sql("SELECT 0 AS query_id, :text AS raw", args={"text": text})
    parsed = parse_queries(given).first()
    if parsed.error is not None:
        raise ValueError(parsed.error)
    spec = SearchSpec(
        parsed.type,
        parsed.pattern,
        parsed.case_sensitive,
        list(parsed.extensions),
        parsed.min_size,
        parsed.max_size,
        parsed.fuzzy_distance,
    )
    return search(df, spec, k)
