"""Keeping a saved catalog current from a stream of changes.

The catalog's folder has the changes themselves beside the saved versions, so that no change is ever
too late: what arrives out of order is put in its place by time. A merge looks again at the paths
that the new batches name and at those whose sessions were still open, takes all their changes,
debounces them, and applies the settled ones to the base version, the one the changes start from.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.merge import apply_changes, effective_changes, replace_paths
from shelfmark.plans.sizing import keep_keys_of
from shelfmark.plans.storage import read_if_there, reliable
from shelfmark.schema import CATALOG_COLUMNS, CATALOG_SCHEMA, catalog_from_manifest
from shelfmark.sources.change_log import filter_ignored
from shelfmark.sources.snapshot import load_catalog, read_manifest, read_version, save_catalog
from shelfmark.streaming.debounce import DEFAULT_DELAY, debounce, micros


Sink = Callable[[DataFrame, int], None]


class _Merge(NamedTuple):
    """``before``: the catalog as it is; ``state``: its new rows for the ``touched`` paths."""

    before: DataFrame
    touched: DataFrame
    state: DataFrame
    watermark: int
    batch: int

    def catalog(self) -> DataFrame:
        return replace_paths(self.before, self.touched, self.state)


def _log_folder(folder: str, generation: int) -> str:
    return f"{folder}/changes/generation={generation}"


def _log(spark: SparkSession, folder: str, manifest: Row) -> DataFrame | None:
    return read_if_there(spark, _log_folder(folder, manifest.generation))


def _merged(
    spark: SparkSession, folder: str, manifest: Row, delay: int, lateness: int, drained: bool
) -> _Merge | None:
    """What has settled since the newest version, or ``None`` if nothing is new.

    With ``drained`` every session counts as settled.
    """
    log = _log(spark, folder, manifest)
    if log is None:
        return None
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    last = log.agg(F.max(F.unix_micros("ts")).alias("ts"), F.max("batch_id").alias("batch")).first()
    if last.ts is None:
        return None
    watermark = last.ts + delay if drained else last.ts - lateness
    if last.batch <= manifest.applied_batch and watermark <= manifest.watermark:
        return None
    watermark = max(watermark, manifest.watermark)
    new = F.col("batch_id") > manifest.applied_batch
    open_before = F.unix_micros("ts") > manifest.watermark - delay
    touched = reliable(log.filter(new | open_before).select("path").distinct())
    rows = keep_keys_of(log.drop("batch_id"), touched, "path").join(touched, "path", "left_semi")
    settled = debounce(rows, timedelta(microseconds=delay)).filter(
        F.unix_micros("settled_at") <= watermark
    )
    base = read_version(spark, folder, manifest.base).join(touched, "path", "left_semi")
    state = apply_changes(base, settled.drop("settled_at"))
    current = load_catalog(spark, folder, check_count=False, manifest=manifest)
    return _Merge(current, touched, state, watermark, last.batch)


def current_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The newest saved version with what has settled since then."""
    manifest = read_manifest(spark, folder)
    found = None
    if manifest is not None and manifest.delay is not None:
        found = _merged(spark, folder, manifest, manifest.delay, manifest.lateness, False)
    return load_catalog(spark, folder, manifest=manifest) if found is None else found.catalog()


def _save_merged(
    spark: SparkSession, folder: str, delay: int, lateness: int, drained: bool,
    on_upsert: Sink | None = None, on_delete: Sink | None = None,
) -> None:
    manifest = read_manifest(spark, folder)
    found = _merged(spark, folder, manifest, delay, lateness, drained)
    if found is None:
        return
    if on_upsert or on_delete:
        found = found._replace(state=reliable(found.state))
        _deliver(found, manifest.number + 1, on_upsert, on_delete)
    save_catalog(
        found.catalog(), folder, applied_batch=found.batch, watermark=found.watermark, base=manifest.base,
        generation=manifest.generation, delay=delay, lateness=lateness,
    )


def _deliver(found: _Merge, number: int, on_upsert: Sink | None, on_delete: Sink | None) -> None:
    """What a merge changes, as rows to put in and paths to take out."""
    rows = keep_keys_of(found.before, found.touched, "path").join(found.touched, "path", "left_semi")
    old = reliable(rows)
    if on_upsert:
        others = F.struct(*[c for c in CATALOG_COLUMNS if c != "path"])
        known = old.select("path", others.alias("known"))
        same = F.col("known").isNotNull() & others.eqNullSafe(F.col("known"))
        on_upsert(found.state.join(known, "path", "left").filter(~same).select(*CATALOG_COLUMNS), number)
    if on_delete:
        on_delete(old.join(found.state, "path", "left_anti").select("path"), number)


def drain(
    spark: SparkSession, folder: str, on_upsert: Sink | None = None, on_delete: Sink | None = None
) -> None:
    """Settle everything that still waits and save it, as at the end of a stream.

    The catalog is then what one batch over all changes gives. A stream may go on afterwards. The
    functions are those of ``maintain_catalog``.
    """
    manifest = read_manifest(spark, folder)
    if manifest is not None and manifest.delay is not None:
        _save_merged(spark, folder, manifest.delay, manifest.lateness, True, on_upsert, on_delete)


def compact(spark: SparkSession, folder: str) -> None:
    """Drain, and start a new log on the result; later changes count as newer than all before.

    Merges read the log since the last compaction. The old log stays in its folder.
    """
    drain(spark, folder)
    manifest = read_manifest(spark, folder)
    catalog = load_catalog(spark, folder, manifest=manifest)
    save_catalog(
        catalog, folder, applied_batch=manifest.applied_batch, generation=manifest.generation + 1,
        delay=manifest.delay, lateness=manifest.lateness,
    )


def maintain_catalog(
    changes: DataFrame,
    folder: str,
    checkpoint: str,
    lateness: timedelta,
    delay: timedelta = DEFAULT_DELAY,
    merge_every: int = 1,
    trigger: dict | None = None,
    on_upsert: Sink | None = None,
    on_delete: Sink | None = None,
) -> StreamingQuery:
    """Leave out ignored paths, debounce, and apply what has settled to the catalog in ``folder``.

    A session settles when changes more than ``lateness`` after its end have been seen; a change that
    comes later still is not lost, its path is settled anew from all its changes. Every micro-batch is
    written under its own number, and every ``merge_every``-th is merged with those before it into a new
    catalog version that records the number; a repeated batch overwrites its own part and is not merged
    twice. A catalog belongs to one checkpoint. Raise ``merge_every`` where the catalog is large:
    rewriting it per batch costs far more than settling the waiting changes on reading
    (``current_catalog``). Call ``drain`` at the end, and ``compact`` from time to time.

    ``on_upsert`` and ``on_delete`` get what each merge changes, rows to put in and paths to take out,
    with the number of the version it makes. A late change that alters what was handed out before
    goes out as a difference, so whoever applies the numbers in order has the catalog itself. They are called
    before the version is saved and must be repeatable: after a failure a number is delivered again.
    """
    waits, late = micros(delay), micros(lateness)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        manifest = read_manifest(spark, folder)
        if batch.isEmpty():
            return
        batch.write.mode("overwrite").parquet(
            f"{_log_folder(folder, manifest.generation)}/batch_id={batch_id}"
        )
        if batch_id > manifest.applied_batch and (batch_id + 1) % merge_every == 0:
            _save_merged(spark, folder, waits, late, False, on_upsert, on_delete)

    spark = changes.sparkSession
    manifest = read_manifest(spark, folder)
    if manifest is None:
        save_catalog(spark.createDataFrame([], CATALOG_SCHEMA), folder, delay=waits, lateness=late)
    elif (manifest.delay, manifest.lateness) != (waits, late):
        save_catalog(
            load_catalog(spark, folder, manifest=manifest), folder, applied_batch=manifest.applied_batch,
            watermark=manifest.watermark, base=manifest.base, generation=manifest.generation,
            delay=waits, lateness=late,
        )
    return (
        filter_ignored(changes).writeStream.outputMode("append")
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def deliver_changes(
    settled: DataFrame,
    on_upsert: Sink,
    on_delete: Sink,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand each micro-batch to user functions: rows to put in, and paths to take out.

    Both get the batch number and must be repeatable, because a batch may be delivered again. The
    batch is computed once and kept in the shared folder for the two. What ``debounce_stream`` drops as
    too late is not delivered; hand the functions to ``maintain_catalog`` where no change may be lost.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        last = reliable(effective_changes(batch))
        writes = F.col("op").isin("create", "modify")
        on_upsert(catalog_from_manifest(last.filter(writes)), batch_id)
        on_delete(last.filter(~writes).select("path"), batch_id)

    return (
        settled.writeStream.outputMode("append")
        .foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
