"""Name, path and extension expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def base_name(path: Column) -> Column:
    """Last component of a path; trailing slashes do not count, ``''`` gives ``'.'``."""
    trimmed = F.rtrim(path, F.lit("/"))
    return (
        F.when(path == "", F.lit("."))
        .when(trimmed == "", F.lit("/"))
        .otherwise(F.substring_index(trimmed, "/", -1))
    )


def extension_of(name: Column) -> Column:
    """Suffix from the last dot, dot included: ``a.tar.gz`` → ``.gz``, ``Makefile`` → ``''``."""
    return F.when(
        F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))
    ).otherwise(F.lit(""))


def normalize_extension(ext: Column) -> Column:
    """Add the leading dot when it is missing; ``''`` stays ``''``; case is kept."""
    return F.when((ext == "") | F.startswith(ext, F.lit(".")), ext).otherwise(
        F.concat(F.lit("."), ext)
    )


def dotted(ext: str) -> str:
    """``normalize_extension`` for a literal known when the plan is built."""
    return ext if ext == "" or ext.startswith(".") else "." + ext


def stem_of(name: Column) -> Column:
    """The name without its extension."""
    return F.when(
        F.contains(name, F.lit(".")),
        F.substring(name, F.lit(1), F.char_length(name) - F.char_length(extension_of(name))),
    ).otherwise(name)
