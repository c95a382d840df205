import hashlib
import random

import numpy as np

from shelfmark.llm import window_dedup as wd
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, window=20):
    """``(id, words, removed, kept)`` per row of ``(id, text)``."""
    first, split = {}, []
    for i, text in rows:
        text = text or ""
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        words = [w for w in text.split(" ") if w]
        split.append((i, words))
        for s in range(len(words) - window + 1):
            key, at = tuple(words[s : s + window]), (i is None, i or 0, s)
            first[key] = min(first.get(key, at), at)
    found = []
    for i, words in split:
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (i is None, i or 0, s):
                gone |= set(range(s, s + window))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        found.append((i, len(words), len(gone), kept))
    return sorted(found, key=repr)


def rows_of(frame, **more):
    found = wd.remove_repeats(frame, **more).collect()
    for r in found:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in found), key=repr)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(map(tuple, QUERIES["op5_window_dedup"](spark, SF).collect()))
    wanted = sorted(brute(docs))
    assert found == [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in wanted]
    assert any(0 < g < n for _, n, g, _ in wanted) and any(g == n for _, n, g, _ in wanted)


def test_shared_passages_in_every_way(docs):
    rng = random.Random(3)

    def prose(n, words="abcdefgh"):
        return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))

    passage = prose(30)
    texts = [prose(rng.randrange(30)) + " " + passage[: rng.randrange(30, 90)] + "  " + prose(9) for _ in range(25)]
    texts += [prose(40, "a"), prose(12, "ab"), prose(7, "a"), prose(200), "é ü " * 9] + [texts[2], texts[3] + "\n"]
    words = prose(120).split()
    for _ in range(8):
        words[rng.randrange(120)] = "Z"
        texts.append("\t".join(words))
    rows = [(rng.randrange(1000), t) for t in texts]
    assert rows_of(docs(*rows), window=7) == brute(rows, 7)


def test_edge_cases(docs, monkeypatch):
    from shelfmark.llm import anchors

    monkeypatch.setattr(anchors, "SLICE", 700)
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "short text"), (7, "short text"), (9, long), (5, "x " + long[900:4000]),
        (6, "t " * 90), (6, "t " * 90), (6, "t " * 60), (None, long), (None, long + " more"), (8, long), (8, long),
    ]
    assert rows_of(docs(*rows)) == brute(rows)
    assert wd.remove_repeats(docs(*rows).limit(0)).count() == 0


def test_window_hashes_are_polynomials():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    for window in (1, 2, 3, 7, 8, 20, 31, 50):
        wanted = [
            sum(int(v) * pow(wd._FACTORS[0], window - 1 - j, 1 << 64) for j, v in enumerate(values[i : i + window])) % (1 << 64)
            for i in range(51 - window)
        ]
        assert wd.window_hashes(values, window, wd._FACTORS[0]).tolist() == wanted
    assert len(wd.window_hashes(values, 51, wd._FACTORS[0])) == 0
