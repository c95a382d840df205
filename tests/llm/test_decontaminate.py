import random
import re

from shelfmark.llm import decontaminate as dc


def brute(text, items, window=13):
    def words(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)

    found, hit, owners = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1) if m else ():
            for j in range(len(found) - m + 1):
                if found[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    owners.add(str(item))
    return len(found), len(hit), sorted(owners)


def check(spark, frame, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.contamination(frame, bench).collect()
    texts = [r.text for r in frame.collect()]
    wanted = sorted(brute(t, [i for i in items if i[0] is not None]) for t in texts)
    assert sorted((r.n_words, r.n_hit, list(r["items"])) for r in found) == wanted
    return bench


def test_random_texts_equal_brute_force(spark, docs):
    """Few different words, so windows, short items, repeats and ties of hashes all occur."""
    rng = random.Random(3)

    def text(n, vocabulary):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 12, 13, 14, 20, 30]), "ab")) for i in range(25)]
    items += [(100 + i, text(20, ["é1", "x", "Ü", "9"])) for i in range(8)]
    frame = docs(*(text(rng.randrange(60), "aB-c") for _ in range(30)),
                 *(text(5, "xyz") + "," + items[-1 - i][1].upper() for i in range(5)))
    check(spark, frame, items)


def test_edge_cases(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "PIECE", 16)  # passages cross the borders of pieces
    passage = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"t{i}" for i in range(400)) + " " + passage + " end"
    items = [(1, passage), (10, None), (2, ""), (None, "t0"), (3, "--- !"), (10, passage.upper()), (4, "Only")]
    frame = docs(None, "", "...", long, (7, long), (7, long), (7, "other"), (None, passage), "only w0")
    bench = check(spark, frame, items)
    kept = dc.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted((r.text or "") for r in kept.collect()) == ["", "", "...", "other"]
    assert dc.contamination(frame.limit(0), bench).count() == 0
    assert {r.n_hit for r in dc.contamination(frame, bench.limit(0)).collect()} == {0}
    assert dc.decontaminate(frame, bench.limit(0)).count() == frame.count()
