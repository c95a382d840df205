import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from shelfmark.llm import near_copies

SF = "/root/testdata/sf0.01"


def brute_set(text, shingle=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def brute_first(texts, groups):
    """The smallest id of every component, by all pairs."""
    sets = {i: brute_set(t) for i, t in texts.items()}
    for i in sets:
        groups.root(i)
    for i, j in combinations(sets, 2):
        small, large = sorted((len(sets[i]), len(sets[j])))
        if 5 * small >= 4 * large:
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (small + large - common):
                groups.link(i, j)
    return {min(m) for m in groups.members()}


def test_stage_loses_no_near_copy(spark, groups):
    table = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 2 = 1 OR doc_id < 300")
    rng = random.Random(3)
    changed = []
    for row in table.orderBy("doc_id").limit(150).collect():
        words = (row.text or "").split(" ")
        for _ in range(rng.randrange(1, 2 + len(words) // 50)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
        changed.append((row.doc_id + 1_000_000, " ".join(words), *row[2:]))
    both = table.unionByName(spark.createDataFrame(changed, table.schema))
    wanted = brute_first({r.doc_id: r.text for r in both.collect()}, groups)
    stage = dict(corpus_pipeline.STAGES)
    found = [r.doc_id for r in stage["jaccard_near_dedup"](spark, both, SF).collect()]
    assert len(found) == len(set(found))
    assert set(found) == wanted
    assert len(wanted) < both.count()


def test_chains_hubs_and_edges(spark, docs, groups):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"c{rng.randrange(10**9)}"
        texts[i] = " ".join(words)
    # Each is close to the next only, and a passage in half of every other text is no copy.
    for i in range(30):
        texts[200 + i] = " ".join(f"d{k}" for k in range(2 * i, 2 * i + 60))
    for i in range(60):
        texts[300 + i] = " ".join(base[:30] + [f"e{i}x{k}" for k in range(30)])
    texts |= {400: "", 401: None, 402: " \n", 403: "One two", 404: "one  TWO", 405: "one two three"}
    found = near_copies.deduplicate(docs(*texts.items()))
    assert {r.doc_id for r in found.collect()} == brute_first(texts, groups)
    empty = near_copies.deduplicate(docs(*texts.items()).limit(0))
    assert empty.count() == 0


def test_hubs_nulls_and_repeated_rows(spark, docs, groups, monkeypatch):
    """Slices of a few members, tiny batches, rows that repeat, rows without an id, a long text."""
    monkeypatch.setattr(near_copies, "_MEMBERS", 3)
    monkeypatch.setattr(near_copies, "_BATCH", 2000)
    rng, base, texts = random.Random(9), [f"w{i}" for i in range(80)], {}
    for i in range(40):
        words = list(base)
        words[rng.randrange(80)] = f"x{i}"
        texts[i] = " ".join(words)
    texts[100] = " ".join(f"l{i}" for i in range(60_000))
    texts[101] = texts[100] + " more"
    rows = [*texts.items(), *list(texts.items())[:5], (None, texts[3]), (None, "alone without an id"), (None, "alone without an id")]
    found = [(r.doc_id, r.text) for r in near_copies.deduplicate(docs(*rows)).collect()]
    wanted = [(i, texts[i]) for i in brute_first(texts, groups)] + [(None, "alone without an id")]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_counts_leave_out_no_similar_sets():
    rng = np.random.default_rng(6)
    left_out = 0
    for _ in range(400):
        size = int(rng.integers(1, 9000))
        a = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.7, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 64, int(rng.integers(0, 1 + size // 4)), np.uint64)]))
        possible = near_copies._may_be_similar(near_copies._cells(a), near_copies._cells(b), 0.8)
        assert possible or not near_copies.similar(a, b)
        other = np.unique(rng.integers(0, 1 << 64, len(a), np.uint64))
        left_out += not near_copies._may_be_similar(near_copies._cells(a), near_copies._cells(other), 0.8)
    assert left_out > 360


def test_fingerprints_give_candidates(spark, docs, groups, monkeypatch):
    """Fingerprints alone link what lies within the bits; shingles add the rest, with any bits."""
    rng, texts = random.Random(11), {}
    for i in range(12):
        words = [f"t{i}w{k}" for k in range(400)]
        for j in range(8):
            copy = list(words)
            for _ in range(rng.randrange(12)):
                copy[rng.randrange(400)] = f"n{rng.randrange(10**9)}"
            texts[100 * i + j] = " ".join(copy)
    frame = docs(*texts.items())
    prints = {i: near_copies.simhash.fingerprint(t, 5) % (1 << 64) for i, t in texts.items()}
    sets = {i: brute_set(t) for i, t in texts.items()}

    def linked(most):
        found = type(groups)()
        for i in texts:
            found.root(i)
        for i, j in combinations(texts, 2):
            common = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= most and 5 * common >= 4 * len(sets[i] | sets[j]):
                found.link(i, j)
        return sorted(map(sorted, found.members()))

    def members(**more):
        found = {}
        for r in near_copies.near_copies(frame, **more).collect():
            found.setdefault(r.root, []).append(r.id)
        return sorted(map(sorted, found.values()))

    wanted = linked(64)
    for bits in (0, 3):
        assert members(bits=bits) == wanted
    shared = near_copies._shared
    monkeypatch.setattr(near_copies, "_shared", lambda *given: shared(*given).limit(0))
    assert members() == linked(near_copies.BITS)
    assert len(wanted) < len(linked(near_copies.BITS)) < len(texts)


def test_signs_leave_out_no_similar_sets():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 3000)), np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 64, 3, np.uint64)]))
        pairs = zip(near_copies._signs(a), near_copies._signs(b))
        bits = sum(((x ^ y) % (1 << 64)).bit_count() for x, y in pairs)
        assert bits <= len(np.setxor1d(a, b))


def test_passage_of_many_documents_makes_few_pairs(spark, docs, groups, monkeypatch):
    """Documents that have most words in common, yet are no near copies, are not all compared."""
    rng, base, texts = random.Random(5), [f"w{i}" for i in range(150)], {}
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(150), 2 + i % 4):
            words[at] = f"x{rng.randrange(10**9)}"
        texts[i] = " ".join(words)
    judged, verified = [], near_copies._verified

    def counted(pairs, *given):
        judged.append(pairs.count())
        return verified(pairs, *given)

    monkeypatch.setattr(near_copies, "_verified", counted)
    found = near_copies.deduplicate(docs(*texts.items()))
    wanted = brute_first(texts, groups)
    assert {r.doc_id for r in found.collect()} == wanted
    assert len(wanted) > 100
    assert judged[-1] < 10 * len(texts)
