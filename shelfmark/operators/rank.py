"""Relevance ranking, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.scoring import score_name, score_recency, score_size


def with_score(
    df: DataFrame,
    query: str = "",
    prefer_exact: bool = True,
    prefer_recent: bool = False,
    prefer_smaller: bool = True,
    case_sensitive: bool = False,
) -> DataFrame:
    """Add ``score``, the sum of the enabled parts; the name part needs a query text."""
    score = F.lit(0)
    if query:
        score = score + score_name(F.col("name"), F.lit(query), prefer_exact, case_sensitive)
    if prefer_recent:
        score = score + score_recency(F.col("modified_time"))
    if prefer_smaller:
        score = score + score_size(F.col("size"))
    return df.withColumn("score", score.cast("int"))


def by_score():
    """Best first; equal scores in path order, so every top-k is deterministic."""
    return [F.col("score").desc(), F.col("path").asc()]


def rank(df: DataFrame, query: str = "", **criteria) -> DataFrame:
    return with_score(df, query, **criteria).orderBy(*by_score())


def top_k(df: DataFrame, k: int = 50, order=None) -> DataFrame:
    """First ``k`` rows: a per-partition heap and a merge of k rows each, not a full sort."""
    return df.orderBy(*(order or by_score())).limit(k)


def not_shown(df: DataFrame, k: int = 50) -> DataFrame:
    """One row: how many rows lie beyond the first ``k``."""
    return df.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("not_shown"))


def sort_by_path(df: DataFrame) -> DataFrame:
    return df.orderBy("path")
