"""Formatting, parsing and distance expressions. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unit letters of printed sizes and factors of size texts.
PRINTED_UNITS = ["KB", "MB", "GB", "TB", "PB", "EB"]
SIZE_FACTORS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}

# Names of the enumerations, in code order from 0.
EVENT_NAMES = ["Create", "Modify", "Delete", "Rename"]
QUERY_TYPES = ["prefix", "exact", "substring", "wildcard", "regex", "fuzzy"]


def human_size(size: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``2.0 MB`` …; ties in the last digit go to the even one."""
    text = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate(PRINTED_UNITS, start=1):
        shown = F.format_string(f"%.1f {unit}", F.bround(size / F.lit(float(1 << 10 * power)), 1))
        last = power == len(PRINTED_UNITS)
        text = text.otherwise(shown) if last else text.when(size < 1 << 10 * (power + 1), shown)
    return text


def format_mtime(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def describe_file(path: Column, size: Column, modified_time: Column, is_dir: Column) -> Column:
    """One printable line per catalog row."""
    return F.format_string(
        "%s: %s (%s, %s)",
        F.when(is_dir, "dir").otherwise("file"),
        path,
        human_size(size),
        format_mtime(modified_time),
    )


def as_bytes_text(text: Column) -> Column:
    """The UTF-8 bytes of a string, one character per byte, so that length, substring and
    distance functions count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance with unit costs over the UTF-8 bytes."""
    return F.levenshtein(as_bytes_text(a), as_bytes_text(b))


def within_distance(a: Column, b: Column, limit: int) -> Column:
    """``edit_distance(a, b) <= limit``; the length test runs first, the distance stops early."""
    return (F.abs(F.octet_length(a) - F.octet_length(b)) <= limit) & (
        F.levenshtein(as_bytes_text(a), as_bytes_text(b), limit) >= 0
    )


def parse_size(text: Column) -> Column:
    """Bytes meant by ``10``, ``100B``, ``1KB``, ``2.5MB`` …; NULL for anything else.

    The longest unit wins (``1KB`` is 1024), fractions need a unit, signs are refused.
    """
    clean = F.upper(F.trim(text))
    with_unit = r"^([0-9]+\.?[0-9]*|\.[0-9]+)\s*([KMGT]?B)\z"
    number = F.regexp_extract(clean, with_unit, 1).try_cast("double")
    unit = F.regexp_extract(clean, with_unit, 2)
    factor = F.lit(None).cast("double")
    for name, value in SIZE_FACTORS.items():
        factor = F.when(unit == name, F.lit(float(value))).otherwise(factor)
    return F.when(clean.rlike(r"^[0-9]+\z"), clean.try_cast("bigint")).otherwise(
        (number * factor).try_cast("bigint")
    )


def wildcard_to_regex(pattern: Column) -> Column:
    """Regex that matches a whole name the way ``*`` and ``?`` read; the rest is literal."""
    quoted = F.regexp_replace(pattern, r"([\\.+^$()\[\]{}|])", r"\\$1")
    stars = F.regexp_replace(quoted, r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(stars, r"\?", "."), F.lit(r"\z"))


def wildcard_to_like(pattern: Column) -> Column:
    """LIKE pattern with the same meaning (``*`` → ``%``, ``?`` → ``_``)."""
    escaped = F.regexp_replace(pattern, r"([\\%_])", r"\\$1")
    return F.translate(escaped, "*?", "%_")


def like_literal(pattern: str) -> str:
    """``wildcard_to_like`` for a literal, so that ``abc*`` can reach the scan as a prefix."""
    for special in ("\\", "%", "_"):
        pattern = pattern.replace(special, "\\" + special)
    return pattern.replace("*", "%").replace("?", "_")


def _name_of(code: Column, names: list[str], unknown: str) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), code), F.lit(unknown))


def event_type_name(code: Column) -> Column:
    return _name_of(code, EVENT_NAMES, "Unknown")


def query_type_name(code: Column) -> Column:
    return _name_of(code, QUERY_TYPES, "unknown")


def for_value(value: str, array: str) -> str:
    """SQL for an array expression over ``t``, with the expression for ``t`` computed once per row.

    Inside a lambda a column expression is computed again for every element, unless it is itself
    the argument of an outer lambda.
    """
    return f"flatten(transform(array({value}), t -> {array}))"
