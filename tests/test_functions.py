from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import naming, predicates as p, scoring, text
from tests.conftest import names, paths


def values(spark, rows, column, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_names_and_extensions(spark):
    given = ["/a/b.tar.gz", "/a/.env", "/a/x.", "/a/Makefile", "/a/dir/", "/", ""]
    assert values(spark, given, naming.base_name(F.col("v"))) == [
        "b.tar.gz", ".env", "x.", "Makefile", "dir", "/", "."
    ]
    given = ["a.tar.gz", ".env", "x.", "Makefile", "a.b\nc"]
    assert values(spark, given, naming.extension_of(F.col("v"))) == [".gz", ".env", ".", "", ".b\nc"]
    given = ["go", ".go", "", "GO"]
    assert values(spark, given, naming.normalize_extension(F.col("v"))) == [".go", ".go", "", ".GO"]
    given = ["a.tar.gz", ".env", "Makefile"]
    assert values(spark, given, naming.stem_of(F.col("v"))) == ["a.tar", "", "Makefile"]


@pytest.mark.parametrize(
    "size, shown",
    [
        (0, "0 B"), (512, "512 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"),
        (1536, "1.5 KB"), (2097152, "2.0 MB"), (1310720, "1.2 MB"), (3221225472, "3.0 GB"),
        (1342177280, "1.2 GB"), (1 << 40, "1.0 TB"), (1 << 50, "1.0 PB"), (1 << 60, "1.0 EB"),
        ((1 << 20) - 1, "1024.0 KB"), (9223372036854775807, "8.0 EB"),
    ],
)
def test_human_size(spark, size, shown):
    assert values(spark, [size], text.human_size(F.col("v")), "v long") == [shown]


def test_describe_file(catalog):
    df = catalog(("/a/b.txt", 1536, False, datetime(2024, 5, 6, 7, 8, 9)), ("/a", 0, True))
    columns = [F.col(c) for c in ("path", "size", "modified_time", "is_dir")]
    lines = [r[0] for r in df.select(text.describe_file(*columns)).collect()]
    assert lines == [
        "file: /a/b.txt (1.5 KB, 2024-05-06 07:08:09)", "dir: /a (0 B, 2024-01-01 00:00:00)"
    ]


def test_edit_distance(spark):
    pairs = [
        ("", "", 0), ("abc", "", 3), ("", "abc", 3), ("abc", "abc", 0), ("abc", "abd", 1),
        ("abc", "adc", 1), ("kitten", "sitting", 3), ("config", "konfig", 1),
        ("config", "contig", 1), ("é", "e", 2),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    wrong = df.filter(text.edit_distance(F.col("a"), F.col("b")) != F.col("d"))
    assert wrong.count() == 0
    near = df.filter(text.within_distance(F.col("a"), F.col("b"), 2) != (F.col("d") <= 2))
    assert near.count() == 0


def test_parse_size(spark):
    given = ["100B", "1KB", "2MB", "1GB", "1TB", "2.5MB", "500", "1kb", "1.7B", ".5KB", " 7 KB"]
    wanted = [100, 1024, 2097152, 1 << 30, 1 << 40, 2621440, 500, 1024, 1, 512, 7168]
    assert values(spark, given, text.parse_size(F.col("v"))) == wanted
    bad = ["abc", "-100", "", "1K", "2.5", "1.2.3KB", "9" * 30, "KB", "1PB"]
    assert values(spark, bad, text.parse_size(F.col("v"))) == [None] * len(bad)


def test_wildcards(spark):
    given = ["test1.txt", "test2.txt", "test10.txt", "testing.txt"]
    for pattern, count in [("test?.txt", 2), ("test*.txt", 4), ("test??.txt", 1), ("*", 4)]:
        regex = text.wildcard_to_regex(F.lit(pattern))
        like = text.wildcard_to_like(F.lit(pattern))
        assert sum(values(spark, given, F.rlike("v", regex))) == count
        assert sum(values(spark, given, F.like("v", like))) == count
        assert sum(values(spark, given, F.col("v").like(text.like_literal(pattern)))) == count
    special = ["a.b", "axb", "a%b", "a_b", r"a\b", "a(b)[c]{d}^$|+"]
    for name in special:
        matched = values(spark, special, F.rlike("v", text.wildcard_to_regex(F.lit(name))))
        assert matched == [s == name for s in special]
        matched = values(spark, special, F.col("v").like(text.like_literal(name)))
        assert matched == [s == name for s in special]


def test_enumeration_names(spark):
    codes = list(range(-1, 7))
    assert values(spark, codes, text.event_type_name(F.col("v")), "v int") == [
        "Unknown", "Create", "Modify", "Delete", "Rename", "Unknown", "Unknown", "Unknown"
    ]
    assert values(spark, codes, text.query_type_name(F.col("v")), "v int") == [
        "unknown", "prefix", "exact", "substring", "wildcard", "regex", "fuzzy", "unknown"
    ]


def test_size_bounds(catalog):
    df = catalog(("/a", 500), ("/b", 50), ("/c", 2000), ("/d", 0, True), ("/e", 100), ("/f", 1000))
    assert paths(df.filter(p.size_between(100, 1000))) == ["/a", "/e", "/f"]
    assert paths(df.filter(p.min_size(1000))) == ["/c", "/f"]
    assert paths(df.filter(p.max_size(50))) == ["/b"]
    assert len(paths(df.filter(p.non_empty()))) == 5
    assert paths(df.filter(p.large())) == []
    assert paths(df.filter(p.large(1000))) == ["/c", "/f"]


def test_time_bounds(catalog):
    days = [datetime(2024, 1, d, 12) for d in (1, 2, 3, 4, 5)]
    df = catalog(*[(f"/{i}", 1, i == 2, day) for i, day in enumerate(days)])
    assert paths(df.filter(p.modified_between(days[1], days[3]))) == ["/1", "/2", "/3"]
    assert paths(df.filter(p.modified_after(days[3]))) == ["/4"]
    assert paths(df.filter(p.modified_before(days[1]))) == ["/0"]
    now = datetime(2024, 1, 5, 12)
    assert paths(df.filter(p.modified_within_days(2, now))) == ["/3", "/4"]
    assert paths(df.filter(p.modified_within_hours(25, now))) == ["/3", "/4"]
    assert paths(df.filter(p.older_than_days(2, now))) == ["/0", "/1"]
    assert paths(df.filter(p.modified_today(datetime(2024, 1, 5, 0, 0, 1)))) == ["/4"]
    midnight = catalog(("/m", 1, False, datetime(2024, 1, 5)))
    assert paths(midnight.filter(p.modified_today(now))) == []
    assert paths(df.filter(p.modified_within_days(1))) == []


def test_extension_lists(catalog):
    df = catalog("/a.txt", "/a.md", "/a.go", "/a.py", "/a.jpg", "/a.png", "/a", ("/d.go", 0, True))
    assert names(df.filter(p.text_files())) == ["a.txt", "a.md"]
    assert names(df.filter(p.code_files())) == ["a.go", "a.py"]
    assert names(df.filter(p.image_files())) == ["a.jpg", "a.png"]
    assert names(df.filter(p.has_any_extension("go", ""))) == ["a.go", "a"]
    assert names(df.filter(p.has_any_extension(".GO"))) == []
    assert names(df.filter(p.has_any_extension())) == []
    assert names(df.filter(p.no_extension())) == ["a"]
    assert len(names(df.filter(p.has_extension()))) == 6
    assert names(df.filter(p.matches_extension("go"))) == ["a.go", "d.go"]
    assert len(names(df.filter(p.matches_extension("")))) == 8


def test_combined_predicates(catalog):
    df = catalog(("/a.go", 10), ("/.b", 2000), ("/c", 3000, True), ("/d.txt", 5000))
    assert len(paths(df.filter(p.any_of()))) == len(paths(df.filter(p.all_of()))) == 4
    chosen = p.all_of(p.min_size(100), p.visible())
    assert paths(df.filter(chosen)) == ["/d.txt"]
    assert sorted(paths(df.filter(chosen)) + paths(df.filter(p.not_(chosen)))) == sorted(paths(df))
    assert paths(df.filter(p.any_of(p.directories(), p.hidden()))) == ["/.b", "/c"]
    assert p.apply_filters(df) is df


def test_ignored_and_skipped(catalog):
    df = catalog(
        "/w/.hidden", "/w/a.tmp", "/w/b.swp", "/w/c.bak", "/w/d~", "/w/Thumbs.db",
        "/w/desktop.ini", "/w/.DS_Store", "/w/ok.txt", "/w/tmp", "/w/.x/ok",
    )
    assert paths(df.filter(~p.should_ignore())) == ["/w/ok.txt", "/w/tmp", "/w/.x/ok"]
    tree = catalog(
        ("/w", 0, True), "/w/a", ("/w/.git", 0, True), "/w/.git/config", "/w/x/node_modules/p.js",
        "/w/node_modules", ("/w/x", 0, True),
    )
    kept = tree.filter(~p.in_skipped_dir(root="/w"))
    assert paths(kept) == ["/w", "/w/a", "/w/node_modules", "/w/x"]
    inside = catalog(("/r/.git", 0, True), "/r/.git/config")
    assert len(paths(inside.filter(~p.in_skipped_dir(root="/r/.git")))) == 2


def test_scores(spark, catalog):
    df = catalog(("/config", 200), ("/config.yaml", 1500), ("/my_config", 2 << 20), ("/readme", 0))
    score = scoring.score_name(F.col("name"), F.lit("Config"))
    assert [r[0] for r in df.select(score).collect()] == [100, 50, 25, 0]
    plain = scoring.score_name(F.col("name"), F.lit("config"), prefer_exact=False)
    assert [r[0] for r in df.select(plain).collect()] == [100, 25, 25, 0]
    exact_case = scoring.score_name(F.col("name"), F.lit("Config"), case_sensitive=True)
    assert [r[0] for r in df.select(exact_case).collect()] == [0, 0, 0, 0]
    assert [r[0] for r in df.select(scoring.score_size(F.col("size"))).collect()] == [10, 5, 0, 10]
    assert [r[0] for r in df.select(scoring.score_recency(F.col("modified_time"))).distinct().collect()] == [0]
