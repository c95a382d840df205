import hashlib
import random
import zlib

import numpy as np
import pytest

from shelfmark.llm import periodic_runs as pr
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """For every period the stretches in which it holds, if no smaller period holds there."""
    numbers = np.unique(np.array([hash(w) for w in words], np.int64), return_inverse=True)[1]
    found = []
    for period in range(1, len(words) // 2 + 1):
        same = np.concatenate([[0], numbers[period:] == numbers[:-period], [0]]).astype(np.int8)
        starts, stops = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for start, stop in zip(starts.tolist(), stops.tolist()):
            length = stop - start + period
            part = words[start : start + length]
            if length >= max(least, 2 * period) and not any(part[p:] == part[:-p] for p in range(1, period)):
                found.append((start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def with_period(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def kept_words(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def sha(text):
    return hashlib.sha256(text).hexdigest()


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(texts)
    several = 0
    for r in rows:
        words = with_period(r.doc_id, (texts[r.doc_id] or "").encode().split())
        runs = brute(words)
        several += len(runs) > 0
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        wanted = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert (r.start, r.length, r.period, r.exponent_milli) == wanted
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode())
        assert r.collapsed_sha256 == sha(b" ".join(kept_words(words, runs)))
    assert several > 5


def random_words(rng):
    size, kinds, words = rng.randrange(70), rng.choice([1, 2, 2, 3, 5]), []
    while len(words) < size:
        if words and rng.random() < 0.3:
            period = rng.randrange(1, min(len(words), 14) + 1)
            words += (words[-period:] * 9)[: rng.randrange(1, 45)]
        else:
            words += [b"w%d" % rng.randrange(kinds) for _ in range(rng.randrange(1, 9))]
    return words


def test_random_words_equal_brute_force():
    rng = random.Random(11)
    for _ in range(4000):
        words, least = random_words(rng), rng.choice([2, 3, 5, 12, 13])
        runs = pr.find_runs(words, least)
        assert runs == brute(words, least), words
        assert pr.collapsed(words, runs) == b" ".join(kept_words(words, runs))


def test_last_places_equal_brute_force():
    """Every access hands out exactly the pieces of the path by the last place of each string."""
    rng = random.Random(5)
    for _ in range(300):
        sequence = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(1, 25))]
        automaton = pr.Automaton(sequence)
        places = pr.LastPlaces(automaton)
        for place in range(1, len(sequence) + 1):
            found = list(places.end(automaton.prefixes[place], place))
            for length in range(1, place + 1):
                string = sequence[place - length : place]
                before = [e for e in range(length, place) if sequence[e - length : e] == string]
                known = [e for longest, e in found if longest >= length]
                assert known[-1:] == before[-1:]


def test_cuts_hold_all_runs():
    words = [b"a%d" % i for i in range(50)] + [b"x", b"y", b"z"] * 5 + [b"b%d" % i for i in range(50)]
    known = {}
    numbers = np.array([known.setdefault(w, len(known)) for w in words])
    assert list(pr.repeated_stretches(numbers)) == [(50, 65)]
    assert pr.find_runs(words) == [(50, 15, 3)]
    assert pr.find_runs(words[:61]) == []  # eleven words
    assert pr.find_runs(words[:62]) == [(50, 12, 3)]


def test_edge_cases(spark, docs):
    texts = {
        1: None, 2: "", 3: " \n\t ", None: "no id " * 6, 4: "é\u00a0ß " * 12, 5: "one " * 150_000,
        6: " ".join(map(str, range(200_000))), 7: "a b\x0bc " * 4 + "a\x1cb",
    }
    frame = docs(*texts.items(), (4, texts[4]))
    found = pr.periodic_runs(frame)
    assert found.columns == ["id", "n_words", "runs", "kept"]
    rows = found.collect()
    assert len(rows) == len(texts) + 1
    by_id = {r.id: (r.n_words, [tuple(x) for x in r.runs], r.kept) for r in rows}
    assert by_id[1] == by_id[2] == by_id[3] == (0, [], "")
    assert by_id[None] == (12, [(0, 12, 2)], "no id")
    assert by_id[4] == (12, [(0, 12, 1)], "é\u00a0ß")
    assert by_id[5] == (150_000, [(0, 150_000, 1)], "one")
    assert by_id[6] == (200_000, [], texts[6])
    assert by_id[7] == (13, [(0, 12, 3)], "a b c a\x1cb")
    assert pr.periodic_runs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(frame, least=1)
