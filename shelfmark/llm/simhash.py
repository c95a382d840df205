"""SimHash near-duplicates; candidates by chains of segments on a ring (pigeonring filtering).

The 64 bits are cut into ``bits + 1`` segments in a ring. If two fingerprints differ in at most
``bits`` places, then at some segment a chain starts whose first l segments differ in at most
l * bits / segments places, for every l: the first segment not at all, the first two together in
one place at most, and so on. So the first two segments, the second also with one bit cleared, are an
equality key of some 43 bits: the one of the pair that has a bit more offers its key without it. No
bucket of merely equal segments is ever paired up; the full check runs in the join's condition.

Equal fingerprints are one node, so copies make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import doc_key, packed, step, unpacked
from shelfmark.llm.components import connected_components

#: Differing bits at which two documents are still linked.
BITS = 2
#: Words in a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42
_SLICE = 50_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, the highest first."""
    columns = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((columns + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BYTE_BITS).ravel()


def fingerprint_of(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of the hashes of a text's shingles, repeats included."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _SLICE):
        counts += _bit_counts(hashes[start : start + _SLICE])
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, total, _SLICE):
        part = words[start : start + _SLICE + shingle - 1]
        if len(words) < shingle:
            grams = [b" ".join(part)]
        else:
            grams = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        counts += _bit_counts(hashes)
    bits = np.packbits(counts * 2 > total)
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, doc, fingerprint)`` per row, written once; ``doc`` tells apart rows that repeat an id."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py()) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["doc"], pa.array(found, pa.int64())], ["id", "doc", "fingerprint"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", doc_key().alias("doc"), "text")
    id_type = rows.schema["id"].dataType.simpleString()
    return step(rows.mapInArrow(per_batch, f"id {id_type}, doc string, fingerprint long"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _segments(bits: int) -> list[list[int]]:
    """Single-bit masks of each segment of the ring."""
    edges = [64 * i // (bits + 1) for i in range(bits + 2)]
    return [[_signed(1 << b) for b in range(lo, hi)] for lo, hi in zip(edges, edges[1:])]


def _entry(segment: int, key: Column, cleared: bool) -> Column:
    return F.struct(
        F.lit(segment).alias("segment"), key.alias("key"), F.lit(cleared).alias("cleared")
    )


def _without_one_bit(segment: int, key: Column, bits: list[int]) -> Column:
    set_bits = F.filter(F.array(*map(F.lit, bits)), lambda b: key.bitwiseAND(b) != F.lit(0))
    return F.transform(set_bits, lambda b: _entry(segment, key.bitwiseXOR(b), True))


def _keys(fingerprint: Column, bits: int, cleared: bool) -> Column:
    """Array of ``(segment, key, cleared)``: the first two segments of the chain from each segment."""
    ring = _segments(bits)
    found = []
    for i, first in enumerate(ring):
        second = ring[(i + 1) % len(ring)] if bits else []
        key = fingerprint.bitwiseAND(F.lit(_signed(sum(b % (1 << 64) for b in first + second))))

        found.append(F.array(_entry(i, key, False)))
        if cleared and second:
            found.append(_without_one_bit(i, key, second))
    return F.concat(*found)


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """``(a, b)``: all pairs of distinct ``fingerprint`` values that differ in ``bits`` or fewer."""

    def offered(cleared: bool) -> DataFrame:
        keys = _keys(F.col("fingerprint"), bits, cleared)
        return nodes.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.*")

    left = offered(True).withColumnRenamed("fingerprint", "a")
    right = offered(False).drop("cleared").withColumnRenamed("fingerprint", "b")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits) & (F.col("a") != F.col("b"))
    once = F.col("cleared") | (F.col("a") < F.col("b"))
    met = left.join(
        right,
        (left["segment"] == right["segment"]) & (left["key"] == right["key"]) & near & once,
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS
) -> DataFrame:
    """``(id, doc, fingerprint, component_id, root)``, one row per row of ``docs``.

    Rows are linked if their fingerprints differ in ``bits`` places or fewer (0 to 2); a component's
    id is its smallest document id, ``root`` its smallest fingerprint. Null texts equal empty ones; their fingerprint is zero and is
    linked like any other. Null ids are never the smallest unless a component has no other. An
    empty table gives no rows.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the chains of two segments are complete for 0 to 2 bits")
    rows = fingerprints(docs, id_col, text_col)
    nodes = step(rows.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    stars = connected_components(links(nodes, bits))
    rooted = nodes.join(stars, nodes["fingerprint"] == stars["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(least, "root").select("fingerprint", "component_id", "root")
    return rows.join(labels, "fingerprint").select(
        "id", "doc", "fingerprint", "component_id", "root"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, the one with the smallest id, with all its columns.

    Of rows that repeat that id one stays; without any id in a component one row stays.
    """
    found = near_duplicates(docs, id_col, text_col)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc")).alias("k"))
    rows = packed(docs, id_col, text_col).select("row", doc_key().alias("doc"))
    met = rows.join(kept.select("k.doc"), "doc", "left_semi")
    return unpacked(met.groupBy("doc").agg(F.first("row").alias("row")))
