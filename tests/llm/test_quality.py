import pytest

from shelfmark.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Hand-made labels take no part in the fit; clean documents are all kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.join(labels, "doc_id", "left_semi").limit(1500)
    found = quality.score_quality(rows, sample=1000).withColumnRenamed("id", "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in found.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    good, bad = counts[1, True] + counts.get((1, False), 0), counts[0, False] + counts.get((0, True), 0)
    assert good > 1000 and bad > 100
    assert counts[1, True] / good >= 0.99
    assert counts[0, False] / bad >= 0.9


def test_em_finds_accuracies():
    """Votes drawn with known accuracies: the estimates come near them, also with missing votes."""
    import random

    rng, truth = random.Random(3), [0.95, 0.9, 0.8, 0.7]
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = "".join(
            "0" if rng.random() < 0.2 else "+" if (rng.random() < a) == good else "-" for a in truth
        )
        counts[votes] = counts.get(votes, 0) + 1
    model = quality.fit_label_model(sorted(counts.items()))
    assert model.prior == pytest.approx(0.8, abs=0.03)
    assert model.accuracies() == pytest.approx(truth, abs=0.03)
    assert model.posterior("++++") > 0.99 > 0.01 > model.posterior("----")
    assert model.posterior("0000") == pytest.approx(model.prior)


def prose(n, seed):
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubdfglmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    lines = (" ".join(rng.choice(words) for _ in range(rng.randrange(5, 15))) for _ in range(n))
    return "\n".join(line.capitalize() + "." for line in lines)


def test_edge_cases(spark, docs):
    junk = "B*** c&&& %%% d### | | | e$$$ f*** g&&& | | h%%%\n"
    clean = prose(9, 1)
    frame = docs(
        None, "", " \n", (703, clean), (703, clean), (None, prose(20_000, 2)), (707, junk * 9), (708, junk * 20),
        *(prose(n, n) for n in range(3, 30)), *(junk * n for n in range(3, 9)),
    )
    rows = quality.score_quality(frame).collect()
    assert len(rows) == frame.count()
    by_id = {r.id: r for r in rows if r.id is not None}
    assert by_id[703].kept and not by_id[707].kept and not by_id[708].kept
    assert {r.kept for r in rows if r.id is None} == {True}
    assert by_id[0].votes == by_id[1].votes == by_id[2].votes
    assert not by_id[0].kept
    assert len({(r.votes, r.label, r.score) for r in rows if r.id == 703}) == 1
    assert quality.score_quality(frame.limit(0)).count() == 0
    alike = quality.score_quality(docs(*[clean] * 5)).collect()
    assert {r.kept for r in alike} == {True}
