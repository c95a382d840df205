import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import merkle, midstates
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def h(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def leaf(*values):
    shown = [None if v is None else str(v).encode() for v in values]
    return h(b"".join(b"-" if v is None else b"%d:%s" % (len(v), v) for v in shown))


def climb(nodes):
    """The last node, and per first node the list of ``(left siblings, right siblings)`` on its way up."""
    ways, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, members = [], []
        for i in range(0, len(nodes), 3):
            part = nodes[i : i + 3]
            for j in range(len(part)):
                for leaf_number in groups[i + j]:
                    ways[leaf_number].append((part[:j], part[j + 1 :]))
            above.append(h("".join(part)))
            members.append([x for g in groups[i : i + 3] for x in g])
        nodes, groups = above, members
    return nodes[0], ways


def brute(rows):
    """``{source: [(leaf, subroot, way)]}`` in the order of the leaves, and the root."""
    sources = sorted({s for s, _, _ in rows}, key=lambda s: b"" if s is None else b"1" + s.encode())
    trees = {}
    for source in sources:
        leaves = [d for s, i, d in sorted((r for r in rows if r[0] == source), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
        trees[source] = (leaves, *climb(leaves))
    root, above = climb([trees[s][1] for s in sources])
    return {
        s: [(d, trees[s][1], way + above[n]) for d, way in zip(trees[s][0], trees[s][2])]
        for n, s in enumerate(sources)
    }, root


def fold(digest, way):
    for left, right in way:
        digest = h("".join([*left, digest, *right]))
    return digest


def test_states_are_those_of_the_hash():
    rng = np.random.default_rng(2)
    for count in (1, 2, 3):
        digests = rng.integers(0, 256, (5000, count, 32)).astype(np.uint8)
        state = np.tile(midstates.START, (5000, 1))
        for i in range(count):
            state = midstates.resumed(state, midstates.digest_blocks(digests[:, i]))
        found = midstates.finished(state, np.full(5000, count))
        for some, digest in zip(digests, found):
            assert digest.tobytes().hex() == h("".join(d.tobytes().hex() for d in some))


@pytest.mark.parametrize("levels", [None, (1, 1), (2, 1)])
def test_query_equals_brute_force(spark, monkeypatch, levels):
    if levels:
        monkeypatch.setattr(merkle, "LEVELS", levels[0])
        monkeypatch.setattr(merkle, "UPPER_LEVELS", levels[1])
        monkeypatch.setattr(merkle, "ROWS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    trees, root = brute([(r.source, r.doc_id, leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text)) for r in docs])
    ways = {d: (subroot, way) for tree in trees.values() for d, subroot, way in tree}
    found = {r.doc_id: r for r in QUERIES["op12_merkle"](spark, SF).collect()}
    assert len(found) == len(docs)
    for r in docs:
        own = leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text)
        subroot, way = ways[own]
        text = r.text
        if text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            text = text.replace("\n", "")
        folded = fold(leaf(r.doc_id, r.source, r.lang, r.n_chars, text), way)
        proof = h("".join(x for left, right in way for x in left + right))
        assert tuple(found[r.doc_id]) == (r.doc_id, own, subroot, root, proof, folded, folded == root)
    assert {r.verified for r in found.values()} == {True, False}


def frame_of(spark, rows):
    rows = [(s, i, bytearray.fromhex(d), bytearray.fromhex(h(d))) for s, i, d in rows]
    return spark.createDataFrame(rows, "source string, id long, digest binary, changed binary")


@pytest.mark.parametrize("sizes", [[], [1], [2], [1, 1], [9, 1, 4], [82, 243, 7], [1] * 30])
def test_trees_of_any_size(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "UPPER_LEVELS", 2)
    rng = random.Random(len(sizes))
    names = [None, "", "0", "é", "ab", *(f"s{i}" for i in range(30))]
    rows = [(names[n], rng.choice([None, rng.randrange(40)]), h(str(rng.random()))) for n, size in enumerate(sizes) for _ in range(size)]
    manifest = merkle.build(frame_of(spark, rows))
    found = merkle.fold(manifest, "changed").collect()
    if not rows:
        assert manifest.root is None and found == []
        return
    trees, root = brute(rows)
    assert manifest.root == root
    assert len(found) == len(rows)
    for r in found:
        digest, subroot, way = trees[r.source][r["index"]]
        assert (r.digest.hex(), r.subroot.hex(), r.total) == (digest, subroot, len(trees[r.source]))
        assert r.siblings.hex() == "".join(x for left, right in way for x in left + right)
        assert r.folded.hex() == fold(h(digest), way)


def test_parents_keep_their_states(spark):
    rows = [("a", i, h(str(i))) for i in range(100)] + [("b", 1, h("b")), (None, 1, h("c"))]
    manifest = merkle.build(frame_of(spark, rows))
    parents = manifest.parents.collect()
    assert len(parents) == 34 + 12 + 4 + 2 + 1 + 1
    nodes = {("source", "1a", 0, i): h(str(i)) for i in range(100)}
    nodes |= {("dataset", "", 0, n): r.digest.hex() for n, r in enumerate(manifest.subroots.orderBy("index").collect())}
    nodes |= {(r.tree, r.key, r.level, r["index"]): r.digest.hex() for r in parents}
    for r in parents:
        children = [nodes.get((r.tree, r.key, r.level - 1, 3 * r["index"] + i)) for i in range(3)]
        children = [c for c in children if c]
        assert len(r.states) == len(children)
        state = midstates.START[None]
        for kept, child in zip(r.states, children):
            assert bytes(kept) == state.astype(">u4").tobytes()
            state = midstates.resumed(state, midstates.digest_blocks(np.frombuffer(bytes.fromhex(child), np.uint8)[None]))
        assert r.digest.hex() == h("".join(children))


def test_numbers_do_not_need_one_task_per_key(spark):
    rows = spark.range(3000).select(F.lit("k").alias("key"), F.xxhash64("id").alias("id")).repartition(7)
    found = merkle.numbered(rows, ["id"]).collect()
    assert [r.id for r in sorted(found, key=lambda r: r["index"])] == sorted(r.id for r in found)
    assert [r["index"] for r in sorted(found, key=lambda r: r.id)] == list(range(3000))
    assert {r.total for r in found} == {3000}


def test_edge_cases(spark, docs):
    long = "long \n text " * 100_000
    frame = docs((1, None), (2, ""), (None, "no id"), (4, "same"), (4, "same"), (5, long))
    leaves = frame.select(
        F.lit(None).cast("string").alias("source"), F.col("doc_id").alias("number"), F.col("id").alias("other"),
        merkle.leaf_digest(F.col("doc_id"), F.col("text")).alias("d"),
    )
    manifest = merkle.build(leaves, id_col="number", digest="d")
    rows = merkle.fold(manifest, "d", digest="d").orderBy("index").collect()
    assert [r.number for r in rows] == [None, 1, 2, 4, 4, 5]
    assert {r.folded.hex() for r in rows} == {manifest.root}
    assert [r.d.hex() for r in rows] == [
        leaf(*x) for x in ((None, "no id"), (1, None), (2, ""), (4, "same"), (4, "same"), (5, long))
    ]
    with pytest.raises(ValueError, match="index"):
        merkle.build(leaves.withColumn("index", F.lit(1)), id_col="number", digest="d")
