from shelfmark.llm import exact_dedup


def rows_of(frame, **more):
    found = exact_dedup.membership(frame, **more).collect()
    return sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in found), key=repr)


def test_edge_cases(spark, docs):
    long = "word \n" * 100_000
    frame = docs(
        (5, None), (2, ""), (7, " "), (8, "\t\n"), (3, "a b"), (1, "a  \r\n b"), (None, "a\tb"),
        (4, long), (6, long), (9, "twice"), (9, "twice"), (None, "x"), (9, "other"),
    )
    assert rows_of(frame) == sorted(
        [
            (5, 2, 2, False), (2, 2, 2, True), (7, 7, 2, True), (8, 7, 2, False),
            (3, 1, 3, False), (1, 1, 3, True), (None, 1, 3, False), (4, 4, 2, True),
            (6, 4, 2, False), (9, 9, 2, True), (9, 9, 2, False), (None, None, 1, True), (9, 9, 1, True),
        ],
        key=repr,
    )
    kept = exact_dedup.deduplicate(frame)
    assert kept.columns == frame.columns
    texts = sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None)
    assert texts == sorted(
        [(2, ""), (7, " "), (1, "a  \r\n b"), (4, long), (9, "twice"), (9, "other")]
    )
    assert kept.count() == 7
    assert exact_dedup.membership(frame.limit(0)).count() == 0


def test_frequent_and_rare_digests_agree(docs):
    """Whatever is split off, the answer is the same."""
    frame = docs(*(f"copy {i % 7 if i % 3 else 0}" for i in range(400)), *(f"own {i}" for i in range(50)))
    wanted = rows_of(frame)
    for heavy, counters in ((1, 2), (3, 4), (1000, 4096)):
        assert rows_of(frame, heavy=heavy, counters=counters) == wanted
