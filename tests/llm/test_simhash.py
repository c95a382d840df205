import random
from itertools import combinations

import xxhash

from shelfmark.llm import simhash
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANKS = "\t\n\x0b\x0c\r "


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in BLANKS:
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints, groups, bits=2):
    for i in fingerprints:
        groups.root(i)
    for (i, f), (j, g) in combinations(fingerprints.items(), 2):
        if (f ^ g).bit_count() <= bits:
            groups.link(i, j)
    return {i: min(m) for m in groups.members() for i in m}


def test_query_equals_brute_force(spark, groups):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    wanted = brute_components(prints, groups)
    found = {r.doc_id: r for r in QUERIES["op10_simhash"](spark, SF).collect()}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {i: r.component_id for i, r in found.items()} == wanted


def test_links_lose_no_pair(spark):
    rng = random.Random(5)
    nodes = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        nodes |= {base, *(base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(6))}
        nodes |= {base ^ 0b111 << rng.randrange(62) for _ in range(3)}
    nodes |= {0, (1 << 64) - 1, 1, 1 << 63, (1 << 63) | 1}
    signed = {simhash._signed(n): n for n in nodes}
    frame = spark.createDataFrame([(n,) for n in signed], "fingerprint long")
    for bits in (0, 1, 2):
        found = {(signed[r.a], signed[r.b]) for r in simhash.links(frame, bits).collect()}
        wanted = {frozenset(p) for p in combinations(nodes, 2) if (p[0] ^ p[1]).bit_count() <= bits}
        assert {frozenset(p) for p in found} == wanted
        assert len(found) == len(wanted)


def test_edge_cases(spark, docs):
    long = " ".join(f"word{i}" for i in range(120_000))
    frame = docs((3, None), (1, ""), (2, " \t\n"), (5, long), (4, long), (4, long), (None, "One"), (9, "oNE"))
    found = [tuple(r) for r in simhash.near_duplicates(frame).select("id", "fingerprint", "component_id").collect()]
    assert sorted((i, c) for i, f, c in found if f == 0) == [(1, 1), (2, 1), (3, 1)]
    assert sorted((i, c) for i, f, c in found if f and i in (4, 5)) == [(4, 4), (4, 4), (5, 4)]
    assert [c for i, _, c in found if i in (None, 9)] == [9, 9]
    expected = simhash._signed(brute_fingerprint(long))
    assert {f for i, f, _ in found if i == 5} == {expected}
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 9]
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
    assert simhash.deduplicate(frame.limit(0)).count() == 0


def test_chains_become_one_component(spark):
    from shelfmark.llm.components import connected_components

    rng = random.Random(1)
    nodes = list(range(200))
    rng.shuffle(nodes)
    pairs = list(zip(nodes[:120], nodes[1:120])) + list(zip(nodes[120:], nodes[121:]))
    found = dict(tuple(r) for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    for part in (nodes[:120], nodes[120:]):
        assert {found.get(n, n) for n in part} == {min(part)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
