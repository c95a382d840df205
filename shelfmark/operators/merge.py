"""Keyed merges. A catalog has one row per path, so no join key here is hot on its side; change
tables may repeat a path any number of times and are reduced to one row per path by a partial
aggregation before they are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.operators.search import present_paths
from shelfmark.plans.sizing import broadcast_if_small
from shelfmark.plans.storage import reliable
from shelfmark.schema import CATALOG_COLUMNS, catalog_from_manifest


def latest_per_path(
    rows: DataFrame, order: list[str], columns: list[str], counted: str | None = None
) -> DataFrame:
    """The last row of every path by ``order``; the other columns break ties. ``counted`` is a column
    for the number of its rows."""
    others = [c for c in columns if c != "path" and c not in order]
    last = F.max(F.struct(*order, *others)).alias("last")
    if counted is None:
        return rows.groupBy("path").agg(last).select("path", "last.*").select(*columns)
    found = rows.groupBy("path").agg(last, F.count(F.lit(1)).alias(counted))
    return found.select("path", "last.*", counted).select(*columns, counted)


def replace_paths(catalog: DataFrame, gone: DataFrame, added: DataFrame) -> DataFrame:
    """Catalog without the paths of ``gone``, plus the rows of ``added``.

    When the paths are few the catalog is only filtered, not shuffled.
    """
    paths = gone.select("path")
    small = broadcast_if_small(paths)
    kept = catalog.join(paths if small is None else small, "path", "left_anti")
    return kept.select(*CATALOG_COLUMNS).unionByName(added.select(*CATALOG_COLUMNS))


def upsert(catalog: DataFrame, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add rows or replace those of the same path; blank paths drop.

    Of rows with one path the last by ``order`` wins, without ``order`` the one modified last.
    """
    given = _one_per_path(rows.filter(F.col("path") != ""), order)
    return replace_paths(catalog, given, given)


def _one_per_path(rows: DataFrame, order: list[str] | None) -> DataFrame:
    """The last row of every path, computed once: the merge reads it several times."""
    order = order or ["modified_time"]
    extra = [c for c in order if c not in CATALOG_COLUMNS]
    return reliable(latest_per_path(rows, order, CATALOG_COLUMNS + extra))


def union_last_wins(frames: list[DataFrame]) -> DataFrame:
    """Union of catalogs; where a path repeats, the row of the later frame stays."""
    numbered = [
        f.select(*CATALOG_COLUMNS, F.lit(i).alias("seq")) for i, f in enumerate(frames)
    ]
    merged = numbered[0]
    for frame in numbered[1:]:
        merged = merged.unionByName(frame)
    return latest_per_path(merged, ["seq"], CATALOG_COLUMNS + ["seq"]).drop("seq")


def update_existing(
    catalog: DataFrame, rows: DataFrame, order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Replace only paths that are present; of rows with one path the last counts, as in ``upsert``.

    Returns the catalog and a report ``(path, found)`` with one row per given path.
    """
    given = _one_per_path(rows.filter(F.col("path") != ""), order).select(*CATALOG_COLUMNS)
    others = [c for c in CATALOG_COLUMNS if c != "path"]
    replacement = given.select("path", F.struct(*others).alias("given"))
    small = broadcast_if_small(replacement)
    joined = catalog.join(replacement if small is None else small, "path", "left")
    updated = joined.select(
        "path",
        *[F.when(F.col("given").isNull(), F.col(c)).otherwise(F.col("given")[c]).alias(c) for c in others],
    )
    return updated, found_report(catalog, given)


def found_report(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path, found)`` for every distinct path asked for.

    The catalog is narrowed to those paths first, by broadcast when they are few.
    """
    asked = paths.select("path").distinct()
    present = present_paths(catalog, asked).withColumn("found", F.lit(True))
    return asked.join(present, "path", "left").select(
        "path", F.coalesce("found", F.lit(False)).alias("found")
    )


def remove(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """Catalog without the given paths; children of a removed directory stay."""
    asked = paths.select("path").distinct()
    small = broadcast_if_small(asked)
    return catalog.join(asked if small is None else small, "path", "left_anti")


def effective_changes(changes: DataFrame) -> DataFrame:
    """The change of each path that decides its state, one row per path.

    A create or modify without metadata (the file was gone when it was looked at) has no effect,
    so it is left out before the last change is chosen: an earlier delete of the path still holds.
    """
    columns = ["path", "op", "ts", "seq", "size", "modified_time", "is_dir"]
    writes = F.col("op").isin("create", "modify")
    return latest_per_path(
        changes.filter(~writes | F.col("size").isNotNull()), ["ts", "seq"], columns
    )


def apply_changes(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Create and modify put the row in, delete and rename take the path out.

    Only the order within a path matters, so the result does not depend on partitioning.
    """
    last = reliable(effective_changes(changes))
    written = last.filter(F.col("op").isin("create", "modify"))
    return replace_paths(catalog, last, catalog_from_manifest(written))
