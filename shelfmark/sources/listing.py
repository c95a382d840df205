"""Listings of directory trees as catalogs.

A tree is listed level by level: the directories of one level are spread over the executors, each
of which reads its directories, and the next level starts from what was written. Levels are kept
in the shared folder, so a lost executor repeats only its own directories. At scale an inventory
table (``catalog_from_manifest``) is the better input; a listing needs a file system that every
executor has mounted.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.predicates import SKIPPED_DIRECTORIES
from shelfmark.operators.merge import latest_per_path
from shelfmark.plans.storage import scratch_path
from shelfmark.schema import CATALOG_COLUMNS, catalog_from_manifest

ENTRY_SCHEMA = "root int, path string, size long, modified_time timestamp, is_dir boolean"
ENTRIES_PER_BATCH = 10_000


def _frame(entries: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(entries, columns=["root", "path", "size", "modified_time", "is_dir"])
    frame["modified_time"] = pd.to_datetime(frame["modified_time"], unit="ns", utc=True)
    return frame


def _entry(root: int, path: str, info: os.stat_result, is_dir: bool) -> tuple:
    return root, path, info.st_size, info.st_mtime_ns // 1000 * 1000, is_dir


def _read_directories(skip: frozenset, include_hidden: bool):
    """Task function: entries of the given directories, in batches whatever their number."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries: list[tuple] = []
            for root, directory in zip(batch["root"], batch["path"]):
                try:
                    listing = os.scandir(directory)
                except OSError as problem:
                    warnings.warn(f"cannot list {directory}: {problem}")
                    continue
                with listing:
                    for item in listing:
                        try:
                            is_dir = item.is_dir(follow_symlinks=False)
                            info = item.stat(follow_symlinks=False)
                        except OSError as problem:
                            warnings.warn(f"cannot read {item.path}: {problem}")
                            continue
                        hidden = item.name.startswith(".") and not include_hidden
                        if hidden or (is_dir and item.name in skip):
                            continue
                        entries.append(_entry(root, item.path, info, is_dir))
                        if len(entries) >= ENTRIES_PER_BATCH:
                            yield _frame(entries)
                            entries = []
            yield _frame(entries)

    return read


def _list_trees(
    spark: SparkSession, roots: list[str], skip_dirs: list[str] | None, include_hidden: bool
) -> DataFrame:
    """Entries of all roots with the number of the root they were reached from."""
    skip = frozenset(SKIPPED_DIRECTORIES if skip_dirs is None else skip_dirs)
    first = []
    for number, root in enumerate(roots):
        path = os.path.abspath(root)
        if not os.path.lexists(path):
            raise FileNotFoundError(f"no such root: {path}")
        first.append(_entry(number, path, os.lstat(path), os.path.isdir(path)))
    base = scratch_path(spark, "listing")
    slots = spark.sparkContext.defaultParallelism * 4
    level, levels = 0, [f"{base}/level=0"]
    spark.createDataFrame(_frame(first), ENTRY_SCHEMA).write.parquet(levels[0])
    while True:
        frontier = spark.read.schema(ENTRY_SCHEMA).parquet(levels[-1]).filter("is_dir")
        waiting = frontier.count()
        if waiting == 0:
            return spark.read.schema(ENTRY_SCHEMA).parquet(*levels)
        level += 1
        levels.append(f"{base}/level={level}")
        spread = frontier.select("root", "path").repartition(min(waiting, slots))
        spread.mapInPandas(_read_directories(skip, include_hidden), ENTRY_SCHEMA).write.parquet(
            levels[-1]
        )


def list_files(
    spark: SparkSession,
    roots: list[str],
    skip_dirs: list[str] | None = None,
    include_hidden: bool = True,
) -> DataFrame:
    """Catalog of the roots and everything below them, directories included.

    Directories with a skipped name are left out with their contents, symbolic links are not
    followed, unreadable entries are warned about; a missing root is an error.
    """
    return catalog_from_manifest(_list_trees(spark, roots, skip_dirs, include_hidden))


def list_object_store(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root on any Hadoop file system, by Spark's own parallel listing.

    Only the file status is read, never the content. Spark lists no directories and no names that
    begin with ``.`` or ``_``.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_time"))
    )
    return catalog_from_manifest(listed, is_dir=None)


def scan_with_callback(df: DataFrame, callback: Callable) -> None:
    """Call a function with every row, on the executors; an exception aborts the job."""

    def each(rows):
        for row in rows:
            callback(row)

    df.foreachPartition(each)


def map_files(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Rows made by a user function from batches of catalog rows (pandas frames in and out)."""
    return df.mapInPandas(function, schema)


def index_roots(
    spark: SparkSession, roots: list[str], skip_dirs: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """One catalog of several roots and the roots that could not be read.

    Blank roots are skipped; where trees overlap the later root's row stays.
    """
    given = [r for r in roots if r.strip()]
    present = [r for r in given if os.path.lexists(r)]
    failed = [r for r in given if r not in present]
    for root in failed:
        warnings.warn(f"cannot index {root}")
    entries = _list_trees(spark, present, skip_dirs, True)
    last = latest_per_path(entries, ["root"], entries.columns)
    return catalog_from_manifest(last).select(*CATALOG_COLUMNS), failed
