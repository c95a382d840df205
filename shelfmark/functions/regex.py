"""Regexes of the linear-time dialect, as Java's: what differs is translated, what Java alone has is refused."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of character classes in brackets.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}",
    "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}",
    "word": r"\w", "xdigit": r"\p{XDigit}",
}

# Constructs that linear-time dialects do not have: look-around, atomic groups, possessive
# quantifiers, other flags, back-references and unknown escapes (the only ones left where they are).
_UNSUPPORTED = r"\(\?(=|!|<=|<!|>)|[*+?}]\+|\(\?[a-zA-Z-]*[^imsU:)<P-][a-zA-Z-]*[:)]|\\[1-9A-Za-z]"

# Letters that have a meaning behind a backslash.
_ESCAPES = "abfnrtvxzABdDsSwWpPQE"

# Quoted text, an escaped sign, a named class, the head of a named group, flags, any other sign.
_TOKENS = r"(?s)\\Q.*?(?:\\E|\z)|\\.|\[:\^?[a-z]+:\]|\(\?P<|\(\?[a-zA-Z-]*[:)]|."
_NAMED = r"^\[:(\^?)([a-z]+):\]$"

# Where the reader is: outside a class, just behind its bracket, behind that and ``^``, further inside.
_OUTSIDE, _OPENED, _NEGATED, _INSIDE = 0, 1, 2, 3


def _named_class(token: Column) -> Column:
    """Java's class for ``[:name:]`` or ``[:^name:]``; names it does not have stay as they are."""
    java = F.lit(None).cast("string")
    for name, positive in POSIX_CLASSES.items():
        negative = positive.replace(r"\p", r"\P").replace(r"\w", r"\W")
        java = F.when(token == f"[:{name}:]", positive).when(token == f"[:^{name}:]", negative).otherwise(java)
    return F.coalesce(java, token)


def _read(state: Column, token: Column) -> Column:
    """The state after one token."""
    at, inside = state["at"], state["at"] != _OUTSIDE
    known = token.rlike(rf"(?s)^\\[^1-9A-Za-z{_ESCAPES}]|^\\[{_ESCAPES}]")
    java = (
        F.when(token == r"\v", r"\x0B")
        .when(inside & token.isin("[", "&"), F.concat(F.lit("\\"), token))
        .when((token == "]") & at.isin(_OPENED, _NEGATED), r"\]")
        .when(inside & token.rlike(_NAMED), _named_class(token))
        .when(~inside & (token == "(?P<"), "(?<")
        .when(~inside & token.startswith("(?"), F.replace(token, F.lit("U"), F.lit("")))
        .otherwise(token)
    )
    bare = (
        F.when(inside, "")
        .when((token == "[") | known, "x")
        .otherwise(token)
    )
    then = (
        F.when(~inside, F.when(token == "[", _OPENED).otherwise(_OUTSIDE))
        .when((token == "]") & (at == _INSIDE), _OUTSIDE)
        .when((token == "^") & (at == _OPENED), _NEGATED)
        .otherwise(_INSIDE)
    )
    return F.struct(
        F.concat(state["java"], java).alias("java"),
        F.concat(state["bare"], bare).alias("bare"),
        then.alias("at"),
    )


def translated(pattern: Column) -> Column:
    """``java``: the pattern in Java's dialect. ``bare``: with classes and known escapes as plain letters.

    Only ``\\n`` ends a line, group names are without ``P``, named classes and flags are Java's, and in a
    class ``[`` and ``&`` are plain signs. The flag that makes quantifiers lazy is left out: it does not
    change whether a text matches. The pattern is read sign by sign, so classes may have any length.
    """
    start = F.struct(F.lit("(?d)").alias("java"), F.lit("").alias("bare"), F.lit(_OUTSIDE).alias("at"))
    return F.aggregate(F.regexp_extract_all(pattern, F.lit(_TOKENS), F.lit(0)), start, _read)


def is_unsupported(bare: Column) -> Column:
    return bare.rlike(_UNSUPPORTED)


def to_java(pattern: Column) -> Column:
    return translated(pattern)["java"]


def is_valid(pattern: Column) -> Column:
    """False for a regex that does not compile or has unsupported constructs."""
    read = F.array(translated(pattern))
    return F.transform(read, lambda t: compiles(t["java"]) & ~is_unsupported(t["bare"]))[0]


def compiles(java: Column) -> Column:
    return F.try_reflect(
        F.lit("java.util.regex.Pattern"), F.lit("compile"), java
    ).isNotNull()
