"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from SimHash first (``simhash``): fingerprints of the same shingles that differ in at most
three bits, found by chains of segments on a ring. Texts that are that similar can lie further apart (up to
11 bits in the test tables), so the shingles themselves find the rest, and no pair is lost (prefix
filtering). If two sets are that similar, they have at least 0.8 of the larger
one in common, so under any one order of all shingles the first fifth (and one more) of the one meets
the first fifth of the other. The order is by hash, with shingles that are frequent in a sample of the
documents last: it decides what a search costs, never what it finds.

Candidates are judged in three rounds, and what a round has tied together is not compared again. In the
first every row is compared with the first one of its fingerprint, and that one with one of a near
fingerprint; in the second every document of a shingle is compared with one of them. So a large group of
copies is tied together by few comparisons. In the third near fingerprints and documents of a shingle that
are still in different components are compared all with all, as far as places and signs allow: if sets meet
first at some places of their orders, they have no more in common than what follows there, and they differ
in as many shingles as their signs (of each of 1,024 cells whether its count is odd) do in bits. Both are
conditions of the join, so documents that only have a passage in common make no rows. Candidates
whose shingles per hash cell differ by more than similar sets can are left out, which loses none; the
others are judged by their whole sets, of 64-bit hashes. A pair has a centre, and sets are sent
to centres: a member's set once per centre, the centre's once per slice of its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.llm import simhash
from shelfmark.llm.common import doc_key, only_with, packed, portions, step, unpacked
from shelfmark.llm.components import connected_components
from shelfmark.plans.sizing import broadcast_if_small, join_hot_keys

#: Words in a shingle, and the similarity from which two documents are copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of the fingerprints that are compared.
BITS = 3
_SEED = 42
#: One document in so many is counted for the order; shingles that this many of them have are frequent.
_SAMPLE, _FREQUENT, _MOST = 16, 3, 200_000
#: Cells of hashes in which a set's shingles are counted: at least so many, and so many that a cell has
#: at most so many shingles on average.
_CELLS, _PER_CELL = 64, 8
#: Words of 64 bits in a set's signs.
_SIGNS = 16
#: So many members are compared with one copy of their centre's set.
_MEMBERS = 500
#: So many bytes of sets go into one batch, but for a set that is larger.
_BATCH = 4 << 20


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of all shingles; a shorter text is one shingle, also the empty one."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter(map(xxh64_intdigest, grams, repeat(_SEED)), np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the shingles."""
    return np.unique(_hashes(text, shingle))


def _least_common(size: int, similarity: float) -> int:
    """What a set of this size has in common with any that is similar enough."""
    return max(1, math.ceil(similarity * size - 1e-9))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _cells(found: np.ndarray) -> bytes:
    """How many shingles lie in each cell, by their first bits; twice as many cells halve every cell."""
    bits = (_CELLS - 1).bit_length()
    while len(found) > _PER_CELL << bits:
        bits += 1
    return np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<i4").tobytes()


def _signs(found: np.ndarray) -> list[int]:
    """Of each cell, by the shingles' last bits, whether it has an odd number of them, as signed words."""
    cells = 64 * _SIGNS
    odd = np.bincount((found % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _may_be_similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether sets with these counts can be: they differ in as many shingles as the cells at least."""
    x, y = np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4")
    cells = min(len(x), len(y))
    x, y = (c.reshape(cells, -1).sum(axis=1) for c in (x, y))
    total, apart = int(x.sum() + y.sum()), int(np.abs(x - y).sum())
    return apart * (1 + similarity) <= total * (1 - similarity) + 1e-6


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.select("id", doc_key().alias("doc"), "text")


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample's frequent shingles, sorted, and the place of each by frequency."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"]:
                found = shingles(text.as_py(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["key"])

    part = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(_SAMPLE)) == 0).select("text")
    counts = part.mapInArrow(per_batch, "key long").groupBy("key").count()
    often = counts.filter(F.col("count") >= _FREQUENT).orderBy(F.desc("count"), "key").limit(_MOST)
    found = often.toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["count"].to_numpy()[order]


def _prefixes(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(node, id, doc, fingerprint, size, cells, signs, keys)``, written once: a row's number, fingerprint,
    counts, signs and first shingles, in the order of all shingles."""
    frequent, counts = _frequent(rows, shingle)

    def prefix(found: np.ndarray) -> np.ndarray:
        many = len(found) - _least_common(len(found), similarity) + 1
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
            found = found[np.lexsort((found, np.where(frequent[at] == found, counts[at], 0)))]
        return found[:many].view(np.int64)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            prints, sets = [], []
            for text in batch["text"]:
                found = _hashes(text.as_py(), shingle)
                prints.append(simhash.fingerprint_of(found))
                sets.append(np.unique(found))
            sizes, keys = pa.array(map(len, sets), pa.int64()), [prefix(s) for s in sets]
            keys = pa.array(keys, pa.list_(pa.int64()))
            cells = pa.array(map(_cells, sets), pa.binary())
            signs = pa.array(map(_signs, sets), pa.list_(pa.int64()))
            prints = pa.array(prints, pa.int64())
            columns = [batch["node"], batch["id"], batch["doc"], prints, sizes, cells, signs, keys]
            yield pa.RecordBatch.from_arrays(
                columns, ["node", "id", "doc", "fingerprint", "size", "cells", "signs", "keys"]
            )

    id_type = rows.schema["id"].dataType.simpleString()
    numbered = rows.withColumn("node", F.monotonically_increasing_id())
    schema = f"node long, id {id_type}, doc string, fingerprint long, size long, "
    schema += "cells binary, signs array<long>, keys array<long>"
    return step(numbered.mapInArrow(per_batch, schema))


def _sizes_fit(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - F.lit(1e-9)


def _by_fingerprint(nodes: DataFrame, bits: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)``: each row with the first of its fingerprint, and the first rows of fingerprints
    that differ in ``bits`` places or fewer, the smaller number as ``a``."""
    offered = nodes.select("fingerprint", "node", "size")
    first = F.min(F.struct("node", "size")).alias("first")
    groups = step(offered.groupBy("fingerprint").agg(first, F.count(F.lit(1)).alias("n")))
    several = groups.filter("n > 1").select("fingerprint", "first")
    equal = join_hot_keys(offered, several, "fingerprint").filter(
        (F.col("node") != F.col("first.node")) & _sizes_fit("size", "first.size", similarity)
    )

    def named(side: str) -> DataFrame:
        return groups.select(F.col("fingerprint").alias(side), F.col("first").alias(f"{side}_first"))

    near = simhash.links(groups.select("fingerprint"), bits).join(named("a"), "a").join(named("b"), "b")
    near = near.filter(_sizes_fit("a_first.size", "b_first.size", similarity))
    numbers = ("a_first.node", "b_first.node")
    return (
        step(equal.select(F.col("first.node").alias("a"), F.col("node").alias("b"))),
        step(near.select(F.least(*numbers).alias("a"), F.greatest(*numbers).alias("b"))),
    )


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b)`` that no component has both of."""
    few = broadcast_if_small(roots)
    roots = roots if few is None else few
    for side in ("a", "b"):
        own = roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        pairs = pairs.join(own, side, "left")
    return pairs.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _shared(nodes: DataFrame, similarity: float) -> DataFrame:
    """``(key, node, size, place, centre, centre_size)`` of shingles that several documents offer; ``place``
    tells how many of the document's shingles come before."""
    offered = nodes.select("node", "size", F.posexplode("keys").alias("place", "key"))
    per_key = W.partitionBy("key")
    centre = F.min(F.struct(F.xxhash64("key", "node"), "node", "size")).over(per_key)
    met = offered.withColumn("n", F.count(F.lit(1)).over(per_key)).withColumn("centre", centre)
    return step(
        met.filter("n > 1").select(
            "key", "node", "size", "place", F.col("centre.node").alias("centre"),
            F.col("centre.size").alias("centre_size"),
        )
    )


def _open_pairs(apart: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: documents of one shingle with different roots whose places and signs allow the similarity.

    ``apart`` has ``key``, ``node``, ``size``, ``place`` and ``root``.
    """
    signs = only_with(nodes.select("node", "signs"), apart.select("node").distinct(), "node")
    signs = signs.select("node", *[F.col("signs")[i].alias(f"sign{i}") for i in range(_SIGNS)])
    signed = step(apart.join(signs, "node"))
    other = signed.select([F.col(c).alias(f"{c}_2") for c in signed.columns])
    both = F.col("size") + F.col("size_2")
    # Of two sets the smaller one, which has the least behind its place, meets the larger one early.
    most = F.lit(similarity / (1 + similarity))
    smaller = signed.filter(F.col("size") - F.col("place") >= 2 * F.col("size") * most - F.lit(1e-6))
    common = F.least(F.col("size") - F.col("place"), F.col("size_2") - F.col("place_2"))
    differ = sum(
        (F.bit_count(F.col(f"sign{i}").bitwiseXOR(F.col(f"sign{i}_2"))) for i in range(_SIGNS)), F.lit(0)
    )
    met = smaller.join(
        other,
        (F.col("key") == F.col("key_2")) & (F.col("root") != F.col("root_2"))
        & (F.struct("size", "node") < F.struct("size_2", "node_2")) & _sizes_fit("size", "size_2", similarity)
        & (common >= both * most - F.lit(1e-6))
        & (differ * (1 + similarity) <= both * (1 - similarity) + F.lit(1e-6)),
    )
    return met.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b"))


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose counts per cell are no further apart than similar sets allow."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch["x"], batch["y"])
            keep = [_may_be_similar(x.as_py(), y.as_py(), similarity) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cells = only_with(nodes.select("node", "cells"), named, "node")
    left = cells.select(F.col("node").alias("a"), F.col("cells").alias("x"))
    right = cells.select(F.col("node").alias("b"), F.col("cells").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return step(both.mapInArrow(possible, "a long, b long"))


def _verified(
    pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float
) -> DataFrame:
    """Those of the pairs ``(a, b)`` that are similar enough; ``a`` is the centre."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["centre", "slice", "node", "found"]
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for text, node, targets in zip(batch["text"], batch["node"], batch["targets"]):
                found = shingles(text.as_py(), shingle).tobytes()
                for target in targets.as_py():
                    out.append((target["centre"], target["slice"], node.as_py(), found))
                    size += len(found)
                    if size > _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, of = np.zeros(0, np.uint64), None
        for batch in batches:
            close = []
            for at, node, found in zip(batch["centre"].to_pylist(), batch["node"].to_pylist(), batch["found"]):
                own = np.frombuffer(found.as_py(), np.uint64)
                if node == at:
                    centre, of = own, at
                elif of == at and similar(centre, own, similarity):
                    close.append((at, node))
            links = list(zip(*close)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in links], ["a", "b"])

    pairs = _possible(pairs, nodes, similarity)
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / _MEMBERS).alias("slices"))
    few = broadcast_if_small(slices)
    members = pairs.join(slices if few is None else few, "a").select(
        F.col("b").alias("node"), F.col("a").alias("centre"),
        F.pmod(F.xxhash64("b"), F.col("slices")).alias("slice"),
    )
    centres = slices.select(
        F.col("a").alias("node"), F.col("a").alias("centre"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"),
    )
    # A node that very many centres are compared with has a row for some of them each.
    part = F.pmod(F.xxhash64("centre"), F.lit(16))
    routes = members.unionByName(centres).groupBy("node", part).agg(
        F.collect_list(F.struct("centre", "slice")).alias("targets")
    )
    routes = step(nodes.select("node", "doc").join(routes, "node").select("node", "doc", "targets"))
    small = broadcast_if_small(routes)
    # Rows that repeat an id and a text have one key and one set; links are told apart later.
    texts = rows.select("doc", "text").join(routes if small is None else small, "doc")
    sets = texts.select("text", "node", "targets").mapInArrow(sent, "centre long, slice long, node long, found binary")
    met = sets.repartition("centre", "slice").sortWithinPartitions("centre", "slice", F.col("node") != F.col("centre"))
    return step(met.mapInArrow(judge, "a long, b long").distinct())


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    bits: int = BITS,
) -> DataFrame:
    """``(id, doc, root)``, one row per row of ``docs``; rows of one component have the same root.

    Rows are linked if their sets of shingles (words between blanks, ASCII letters folded) are at
    least so similar. A text of ``shingle`` words or fewer is one shingle; null texts equal empty ones.
    ``bits`` says how far apart fingerprints may be that are compared; the result is the same with any.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity is above 0 and at most 1")
    rows = _rows(docs, id_col, text_col)
    nodes = _prefixes(rows, shingle, similarity)

    equal, near = _by_fingerprint(nodes, bits, similarity)
    first = step(equal.unionByName(near.groupBy("b").agg(F.min("a").alias("a"))))
    links = _verified(first, nodes, rows, shingle, similarity)
    roots = connected_components(links)

    shared = _shared(nodes, similarity)
    second = shared.filter(_sizes_fit("size", "centre_size", similarity) & (F.col("node") != F.col("centre")))
    second = second.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    second = step(_apart(second, roots))
    links = roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(
        _verified(second, nodes, rows, shingle, similarity)
    )
    roots = connected_components(links)

    apart = shared.select("key", "node", "size", "place").join(roots, "node", "left")
    apart = apart.withColumn("root", F.coalesce("root", "node"))
    mixed = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    apart = apart.join(mixed.filter("low < high").select("key"), "key", "left_semi")
    open_pairs = _open_pairs(step(apart), nodes, similarity)
    known = first.unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    third = open_pairs.unionByName(_apart(near, roots)).distinct()
    third = step(third.join(known, ["a", "b"], "left_anti"))
    links = roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(
        _verified(third, nodes, rows, shingle, similarity)
    )

    stars = connected_components(links)
    rooted = nodes.select("node", "id", "doc").join(stars, "node", "left")
    return rooted.select("id", "doc", F.coalesce("root", "node").alias("root"))


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row of every component, the one with the smallest id, with all its columns.

    Of rows that repeat that id one stays; without any id in a component one row stays.
    """
    found = step(near_copies(docs, id_col, text_col, shingle, similarity))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc")).alias("k"))
    # Those that go are few, and so are rows that repeat an id and a text: no other row is shuffled.
    gone = step(found.select("doc").distinct().join(kept.select("k.doc"), "doc", "left_anti"))
    repeated = step(found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc"))
    rows = packed(docs, id_col, text_col).select("row", doc_key().alias("doc"))
    rows = only_with(rows, gone, "doc", "left_anti")
    single = only_with(rows, repeated, "doc", "left_anti").select("row")
    first = only_with(rows, repeated, "doc").groupBy("doc").agg(F.first("row").alias("row"))
    return unpacked(single.unionByName(first.select("row")))
