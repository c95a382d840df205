"""Saved catalogs.

A snapshot folder holds ``data/<id>`` (Parquet, range-partitioned and sorted by path, so that
prefix and exact-path searches skip files and row groups) and ``manifests`` (one small JSON row per
version). The manifest row is written last; a version without one is never seen. One writer at a
time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from shelfmark.operators.merge import latest_per_path
from shelfmark.plans.storage import reliable
from shelfmark.schema import CATALOG_COLUMNS, CATALOG_SCHEMA
from shelfmark.sources.json_document import ORDER, read_document

# Fixed value: the only snapshot format version.
FORMAT_VERSION = "1.0"

#: Watermark of a catalog to which no changes were applied: before any time.
NEVER = -(1 << 62)

MANIFEST_SCHEMA = (
    "version string, created_at timestamp, file_count long, total_size long, "
    "compressed boolean, data string, applied_batch long, number long, base string, "
    "generation long, watermark long, delay long, lateness long"
)


def _publish(spark: SparkSession, folder: str, manifest: dict) -> None:
    row = spark.createDataFrame([Row(**manifest)], MANIFEST_SCHEMA)
    row.coalesce(1).write.mode("append").json(f"{folder}/manifests")


def read_manifest(spark: SparkSession, folder: str) -> Row | None:
    """The manifest row with the highest number, or ``None`` where nothing was saved."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{folder}/manifests")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.orderBy(F.col("number").desc()).first()


def save_catalog(
    df: DataFrame,
    folder: str,
    compress: bool = True,
    partitions: int | None = None,
    applied_batch: int = -1,
    watermark: int = NEVER,
    base: str | None = None,
    generation: int = 0,
    delay: int | None = None,
    lateness: int | None = None,
) -> Row:
    """Write a new version and return its manifest; a repeated path is refused.

    Without ``partitions`` Spark sizes the files itself (adaptive coalescing after the shuffle).
    Counts come from the written files, so the input is not evaluated again for them. The last
    arguments are for ``maintain_catalog``: how far its log is applied, to which version, and its times.
    """
    spark = df.sparkSession
    before = read_manifest(spark, folder)
    name = uuid.uuid4().hex
    numbers = [partitions] if partitions else []
    ranged = df.select(*CATALOG_COLUMNS).repartitionByRange(*numbers, "path")
    codec = "zstd" if compress else "none"
    data = f"{folder}/data/{name}"
    ranged.sortWithinPartitions("path").write.option("compression", codec).parquet(data)
    _check_paths(spark.read.parquet(data))
    totals = (
        spark.read.parquet(data)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        .first()
    )
    manifest = {
        "version": FORMAT_VERSION,
        "created_at": datetime.now(timezone.utc),
        "file_count": totals.n,
        "total_size": totals.bytes,
        "compressed": compress,
        "data": name,
        "applied_batch": applied_batch,
        "number": 0 if before is None else before.number + 1,
        "base": base or name,
        "generation": generation,
        "watermark": watermark,
        "delay": delay,
        "lateness": lateness,
    }
    _publish(spark, folder, manifest)
    return Row(**manifest)


def _checked_manifest(spark: SparkSession, folder: str, manifest: Row | None = None) -> Row:
    manifest = manifest or read_manifest(spark, folder)
    if manifest is None:
        raise FileNotFoundError(f"no catalog was saved in {folder}")
    _check_format(manifest.version)
    return manifest


def _check_format(version: str) -> None:
    if version != FORMAT_VERSION:
        raise ValueError(f"format {version} is not known, only {FORMAT_VERSION}")


def _check_count(manifest: Row, found: int) -> None:
    if manifest.file_count != found:
        raise ValueError(f"{manifest.file_count} files were recorded and {found} are there")


def read_version(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/data/{name}")


def load_catalog(
    spark: SparkSession, folder: str, check_count: bool = True, manifest: Row | None = None
) -> DataFrame:
    """The newest version, or that of a manifest read before. The row count is compared with the
    manifest, from the file footers alone; ``check_count=False`` saves opening every file where the
    count was checked before."""
    manifest = _checked_manifest(spark, folder, manifest)
    df = read_version(spark, folder, manifest.data)
    if check_count:
        _check_count(manifest, df.count())
    return df


def validate_catalog(spark: SparkSession, folder: str) -> None:
    """Raise for a missing, foreign or damaged catalog, or for one with a repeated path."""
    _check_paths(load_catalog(spark, folder))


def _check_paths(saved: DataFrame) -> None:
    """Raise if a path repeats in a saved version, without a shuffle of its rows.

    Files hold ranges of paths in order, so a repeat is next to its like in one file: every file gives
    its first and last path, and any path equal to the one before it.
    """

    def per_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task may read several files, and parts of files, one after the other.
        for batch in batches:
            files, found = batch["file"].to_pylist(), batch["path"].to_pylist()
            last = len(found) - 1
            edges = [
                i for i in range(last + 1)
                if i in (0, last) or found[i] in (found[i - 1], found[i + 1]) or files[i] != files[i - 1]
            ]
            yield batch.take(pa.array(edges, pa.int64())).select(["path"])

    named = saved.select("path", F.input_file_name().alias("file"))
    few = named.mapInArrow(per_part, "path string")
    repeated = few.groupBy("path").count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"path is repeated: {repeated[0].path}")


def backup_catalog(spark: SparkSession, folder: str, now: datetime | None = None) -> str:
    """Copy the newest version next to the folder; returns the copy's location.

    The copy keeps the order of the paths: every file is range-partitioned and sorted like the
    original, so searches in it skip as much. It is a catalog of its own, without a change log.
    """
    manifest = _checked_manifest(spark, folder)
    moment = now or datetime.now(timezone.utc)
    target = f"{folder.rstrip('/')}.backup.{moment:%Y%m%d_%H%M%S}"
    codec = "zstd" if manifest.compressed else "none"
    data = read_version(spark, folder, manifest.data)
    ranged = data.repartitionByRange("path").sortWithinPartitions("path")
    ranged.write.option("compression", codec).parquet(f"{target}/data/{manifest.data}")
    _publish(spark, target, manifest.asDict() | {"number": 0, "base": manifest.data})
    return target


def clear_catalog(spark: SparkSession, folder: str) -> None:
    """Make the catalog empty; nothing to do where none was saved."""
    if read_manifest(spark, folder) is not None:
        save_catalog(spark.createDataFrame([], CATALOG_SCHEMA), folder)


def _check_head(head: Row | None, found: int, path: str) -> None:
    if head is None or head.version is None:
        raise ValueError(f"not a snapshot document: {path}")
    _check_format(head.version)
    _check_count(head, found)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of a snapshot kept as one JSON document, plain or ``.gz``, in any layout.

    The document is taken apart in parallel (a compressed one is still one stream). Of entries with one path
    the later stays. An entry without a path, or another number of entries than recorded, is an error.
    """
    head, entries = read_document(spark, path)
    # The entries are read once: what is counted is kept.
    latest = reliable(latest_per_path(entries, ORDER, CATALOG_COLUMNS + ORDER, "n").drop(*ORDER))
    totals = latest.select(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum(F.when(F.col("path").isNotNull(), F.col("n"))), F.lit(0)).alias("named"),
    ).first()
    _check_head(head, totals.entries, path)
    if totals.named != totals.entries:
        raise ValueError(f"{totals.entries - totals.named} entries cannot be read: {path}")
    return latest.drop("n")
