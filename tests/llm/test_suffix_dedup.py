import hashlib
import random
import string
from collections import Counter

from shelfmark.llm import anchors, bwt, suffix_dedup
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(texts, length=400):
    """``(bytes, removed, spans, kept)`` per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    found = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        found.append((len(d), sum(gone), runs, kept))
    return found


def rows_of(frame, **more):
    found = suffix_dedup.remove_repeats(frame, **more).collect()
    for r in found:
        assert r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)
    return sorted((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in found)


def test_query_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    found = sorted(map(tuple, QUERIES["op9_suffix_dedup"](spark, SF).collect()))
    wanted = brute([t for _, t in docs])
    assert found == [
        (i, n, removed, runs, hashlib.sha256(kept).hexdigest())
        for (i, _), (n, removed, runs, kept) in zip(docs, wanted)
    ]
    assert 0 < sum(w[1] for w in wanted)


def test_shared_passages_in_every_way(docs):
    rng = random.Random(6)

    def prose(n):
        return "".join(rng.choice("abcdeé ") for _ in range(n))

    passage, short = prose(60), prose(29)
    texts = [prose(rng.randrange(200)) + passage[: rng.randrange(20, 61)] + prose(rng.randrange(50)) for _ in range(20)]
    texts += [prose(10) + short + prose(10) for _ in range(4)]
    texts += ["ab" * 100, "ab" * 15 + "x", "a" * 31, "a" * 30, prose(300)] + [texts[3]] * 3
    copy = list(prose(400))
    texts.append("".join(copy))
    for _ in range(6):
        copy[rng.randrange(400)] = "Z"
        texts.append("".join(copy))
    frame = docs(*texts)
    wanted = sorted(brute(texts, 30))
    for crowd in (512, 2):  # halved once, and down to single windows
        assert rows_of(frame, length=30, crowd=crowd) == wanted


def test_one_passage_in_very_many_documents(docs, monkeypatch):
    rng = random.Random(8)

    def prose(n):
        return "".join(rng.choice("abcdeé ") for _ in range(n))

    made = []
    halves = suffix_dedup._halves

    def counted(*args):
        made.append(halves(*args))
        return made[-1]

    monkeypatch.setattr(suffix_dedup, "_halves", counted)
    below, above = prose(29)[:29], prose(45)
    texts = [prose(20) + below + prose(20) for _ in range(300)] + [prose(20) + above + prose(20) for _ in range(300)]
    assert rows_of(docs(*texts), length=30, crowd=8) == sorted(brute(texts, 30))
    assert len(made) > 2
    assert all(m.count() <= 5 * len(texts) for m in made)


def test_planted_passages_of_400_bytes_and_more(spark):
    """Every planted passage of 400 bytes goes, from 399 bytes down none does, other documents stay."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    plain = {i: n[1] for (i, _), n in zip(rows, brute([t for _, t in rows]))}
    rng = random.Random(5)
    texts = {i: t or "" for i, t in rows}
    clean = [i for i, gone in plain.items() if not gone]
    long, short = set(), set()
    for size, into in ((400, long), (450, long), (900, long), (399, short), (345, short)):
        passage = "".join(rng.choice("abcdefgh ") for _ in range(size))
        for i, own in zip(rng.sample([i for i in clean if i not in long | short], 25), string.ascii_uppercase):
            at = rng.randrange(len(texts[i]) + 1)
            # A sign of its own at each end, so that the passage is not longer by chance.
            texts[i] = texts[i][:at] + own + passage + own + texts[i][at:]
            into.add(i)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.id: r.n_bytes - len(r.kept) for r in suffix_dedup.remove_repeats(frame, crowd=8).collect()}
    assert {i for i in clean if found[i]} == long
    assert all(found[i] == plain[i] for i in plain if i not in clean)


def test_edge_cases(docs, monkeypatch):
    long = "".join(random.Random(1).choice("abcdef") for _ in range(30_000))
    monkeypatch.setattr(anchors, "SLICE", 7000)
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (5, "x" + long[9000:12_000]), (6, "t" * 900), (6, "t" * 900), (None, "u" * 399)]
    assert rows_of(docs(*rows)) == sorted(brute([t for _, t in rows]))
    assert suffix_dedup.remove_repeats(docs(*rows).limit(0)).count() == 0


def test_transform_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        length = rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 40])
        alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(20))])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(rng.randrange(1, 8))]
        if rng.random() < 0.5:
            strings.append(strings[0][:60] + b"x" + strings[0][10:])
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        wanted = [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
        assert [list(map(bool, x)) for x in bwt.repeated_starts(strings, length)] == wanted
