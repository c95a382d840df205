"""Query texts as a table: one row of settings, or one error, per row of text.

Everything is a column expression, so a query log of any size is read in one narrow pass, and a
bad text marks its own row instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import regex
from shelfmark.functions.text import parse_size
from shelfmark.operators.search import (
    DEFAULT_FUZZY_DISTANCE,
    MAX_FUZZY_DISTANCE,
    MIN_FUZZY_DISTANCE,
)
from shelfmark.schema import QUERY_SCHEMA

# Leading words that set the query type.
TYPE_WORDS = ["regex", "fuzzy", "exact"]
TYPE_WORD = f"^({'|'.join(TYPE_WORDS)}):"

MAX_BYTES = (1 << 63) - 1
SIZE_OPTION = r"^(>=|<=|>|<)(.*)\z"

# A token that belongs to the pattern: one without a colon, or a first one with a type word.
_IS_PATTERN = f"(NOT contains(t, ':') OR (i = 0 AND t RLIKE r'{TYPE_WORD}'))"


def _read_size(value: Column) -> Column:
    """Operator, bytes (NULL if unreadable, or if nothing can be beyond) and text of one size option."""
    operator = F.regexp_extract(value, SIZE_OPTION, 1)
    bytes_ = parse_size(F.regexp_extract(value, SIZE_OPTION, 2))
    return F.struct(
        operator.alias("operator"),
        F.when((operator != ">") | (bytes_ < MAX_BYTES), bytes_).alias("bytes"),
        value.alias("text"),
    )


def _last(array: str) -> str:
    """SQL for the last element, NULL for an empty array: of repeated options the later counts."""
    return f"try_element_at({array}, -1)"


def _values_of(*keys: str) -> str:
    """SQL for the values of the options with one of the keys."""
    listed = ", ".join(f"'{key}'" for key in keys)
    return f"transform(filter(options, o -> o.key IN ({listed})), o -> o.value)"


def _bound(inclusive: str, strict: str, step: str) -> str:
    """SQL for the last bound with one of the two operators; the strict one moves it by a byte."""
    last = _last(f"filter(sizes, s -> s.operator IN ('{inclusive}', '{strict}'))")
    return f"{last}.bytes + IF({last}.operator = '{strict}', {step}, 0)"


def parse_queries(df: DataFrame, query_id: str = "query_id", raw: str = "raw") -> DataFrame:
    """Read ``raw`` into the columns of ``QUERY_SCHEMA``.

    Tokens with a colon are options (``ext``/``extension``, ``size``, ``case``, ``fuzzy``, others
    are ignored) and the rest, joined by one space, is the pattern; only a first token that
    starts with ``regex:``, ``fuzzy:`` or ``exact:`` belongs to the pattern and sets the type. A
    text of effective filters alone has the pattern ``''`` and selects by filter only.
    """
    split = df.selectExpr(
        f"CAST({query_id} AS BIGINT) AS query_id",
        f"{raw} AS raw",
        f"filter(split(coalesce({raw}, ''), r'(?U)\\s+'), t -> t <> '') AS tokens",
    ).selectExpr(
        "query_id",
        "raw",
        "size(tokens) = 0 AS blank",
        f"array_join(filter(tokens, (t, i) -> {_IS_PATTERN}), ' ') AS text",
        f"""transform(filter(tokens, (t, i) -> NOT {_IS_PATTERN}), t -> struct(
              lower(substring_index(t, ':', 1)) AS key,
              regexp_extract(t, r'(?s)^[^:]*:(.*)\\z', 1) AS value)) AS options""",
    )
    read = split.withColumn("sizes", F.transform(F.expr(_values_of("size")), _read_size))
    limits = f"{MIN_FUZZY_DISTANCE}, least({MAX_FUZZY_DISTANCE}, distance)"
    settings = read.selectExpr(
        "query_id",
        "raw",
        "blank",
        f"""CASE WHEN text RLIKE r'{TYPE_WORD}' THEN regexp_extract(text, r'{TYPE_WORD}', 1)
                 WHEN text RLIKE r'^[/\\\\]' THEN 'prefix'
                 WHEN text RLIKE r'[*?]' THEN 'wildcard'
                 ELSE 'substring' END AS type""",
        f"regexp_replace(text, r'{TYPE_WORD}', '') AS pattern",
        f"coalesce(lower({_last(_values_of('case'))}) = 'true', false) AS case_sensitive",
        f"""transform(filter(
              transform(split(coalesce({_last(_values_of('ext', 'extension'))}, ''), ','), e -> trim(e)),
              e -> e <> ''), e -> IF(startswith(e, '.'), e, concat('.', e))) AS extensions""",
        f"{_bound('>=', '>', '1')} AS min_size",
        f"{_bound('<=', '<', '-1')} AS max_size",
        f"""coalesce({_last(f"""filter(
              transform({_values_of('fuzzy')}, v -> try_cast(regexp_extract(v, '^([+-]?[0-9]+)', 1) AS INT)),
              n -> n IS NOT NULL)""")}, {DEFAULT_FUZZY_DISTANCE}) AS distance""",
        f"IF(type = 'fuzzy', greatest({limits}), distance) AS fuzzy_distance",
        "try_element_at(filter(sizes, s -> s.bytes IS NULL), 1).text AS bad_size",
        "type = 'substring' AND (size(extensions) > 0 OR min_size IS NOT NULL "
        "OR max_size IS NOT NULL) AS filters_only",
    )
    valid = F.when((F.col("type") != "regex") | (F.col("pattern") == ""), True).otherwise(
        regex.is_valid(F.col("pattern"))
    )
    checked = settings.withColumn("regex_ok", valid)
    return checked.selectExpr(
        *[f.name for f in QUERY_SCHEMA if f.name != "error"],
        """CASE WHEN blank THEN 'nothing is asked for'
                WHEN bad_size IS NOT NULL THEN concat('not a size: ', bad_size)
                WHEN trim(pattern) = '' AND NOT filters_only THEN 'there is no pattern'
                WHEN NOT regex_ok THEN 'this regex cannot be used' END AS error""",
    )


def validate_queries(queries: DataFrame) -> DataFrame:
    """Fill ``error`` for rows that were read but make no sense together."""
    no_pattern = (F.col("pattern") == "") & (F.size("extensions") == 0)
    no_pattern &= F.col("min_size").isNull() & F.col("max_size").isNull()
    crossed = (F.col("min_size") > 0) & (F.col("max_size") > 0)
    crossed &= F.col("min_size") > F.col("max_size")
    return queries.withColumn(
        "error",
        F.coalesce(
            F.col("error"),
            F.when(no_pattern, "there is neither a pattern nor a filter"),
            F.when(
                crossed,
                F.format_string(
                    "least size %d is above largest size %d",
                    F.col("min_size"),
                    F.col("max_size"),
                ),
            ),
        ),
    )
