import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import regex
from shelfmark.functions.required import required_parts
from shelfmark.operators import batch_search, rank, search as s, stats
from shelfmark.operators.batch_search import search_many, size_cells
from shelfmark.operators.fuzzy_join import close_pairs, fuzzy_join
from shelfmark.operators.query_table import parse_queries, validate_queries
from shelfmark.operators.search import SearchSpec
from shelfmark.plans.sizing import first_k_per
from tests.conftest import names, paths


@pytest.fixture(scope="module")
def search_files(catalog):
    return catalog(
        ("/home/user/config.yaml", 100), ("/home/user/config.txt", 200), ("/home/user/test.go", 500),
        ("/home/user/test_utils.go", 600), ("/var/log/README.md", 50),
    )


def test_prefix_search(catalog):
    df = catalog(
        "/home/user/documents/file2.txt", "/home/user/documents/file1.txt",
        "/home/user/docs/readme.md", "/var/log/syslog", "/var/log/messages",
    )
    found = paths(s.search_prefix(df, "/home/user/doc"))
    assert found == sorted(found) and len(found) == 3
    assert len(paths(s.search_prefix(df, ""))) == 5
    unicode = catalog("/home/用户/文档.txt", "/home/usuario/año.txt", "/home/пользователь/ф", "/home/🎉/a")
    assert len(paths(s.search_prefix(unicode, "/home/用户"))) == 1
    assert paths(s.all_files(catalog("zebra", "apple", "monkey", "banana"))) == ["apple", "banana", "monkey", "zebra"]


def test_name_and_extension_search(catalog):
    df = catalog("/home/user/README.md", "/var/www/readme.txt", "/home/user/config.yaml", ("/d.txt", 0, True))
    assert len(paths(s.search_name(df, "ReadMe"))) == 2
    assert paths(s.search_name(df, "")) == []
    assert len(paths(s.search_extension(df, "txt"))) == 2
    assert paths(s.search_extension(df, "")) == []
    assert paths(s.files_by_extension(df, "txt")) == ["/var/www/readme.txt"]
    assert len(paths(s.files_by_extension(df, ""))) == 3
    images = catalog("/photo1.jpg", "/photo2.png", "/photo3.gif", "/manual.pdf", "/readme.txt")
    assert paths(s.search_extensions(images, [".jpg", "jpg", ".png"])) == ["/photo1.jpg", "/photo2.png"]
    assert paths(s.search_extensions(images, [])) == []


def test_case(catalog):
    df = catalog("/README.txt", "/readme.txt", "/ReadMe.txt")
    assert len(paths(s.search_text(df, "readme"))) == 3
    assert paths(s.search_text(df, "readme case:true")) == ["/readme.txt"]
    assert paths(s.search_text(df, "exact:README.txt case:TRUE")) == ["/README.txt"]
    assert len(paths(s.search_text(df, "READ*.TXT"))) == 3
    assert paths(s.search_text(df, "READ*.txt case:true")) == ["/README.txt"]


def test_wildcard_regex_fuzzy(catalog):
    df = catalog("/home/test1.txt", "/home/test2.txt", "/home/test10.txt", "/home/testing.txt")
    for pattern, count in [("test?.txt", 2), ("test*.txt", 4), ("test??.txt", 1)]:
        assert len(paths(s.search_wildcard(df, pattern))) == count
    assert len(paths(s.search_regex(df, r"test[0-9]+\.txt"))) == 3
    assert len(paths(s.search_regex(df, r"^test[12]\.txt$"))) == 2
    assert paths(s.search_regex(df, "TEST")) == []
    assert len(paths(s.search_regex(df, "(?i)TEST(?P<n>1)"))) == 2
    for bad in ["[invalid(", "(?=a)", r"(a)\1", "a++", "(?<!x)y"]:
        with pytest.raises(ValueError):
            s.search_regex(df, bad)
    fuzzy = catalog("/config.txt", "/konfig.txt", "/contig.txt", "/readme.txt")
    assert len(paths(s.search_fuzzy(fuzzy, "config", 1, on="stem"))) == 3
    assert paths(s.search_fuzzy(fuzzy, "CONFIG.TXT", 0)) == ["/config.txt", "/contig.txt", "/konfig.txt"]
    assert paths(s.search_fuzzy(fuzzy, "config", 9)) == ["/config.txt", "/contig.txt", "/konfig.txt"]
    assert paths(s.search_fuzzy(fuzzy, "config")) == []


def test_existence(catalog, spark, search_files):
    assert s.contains_path(search_files, "/home/user/test.go").first().found
    assert not s.contains_path(search_files, "/home/user").first().found
    asked = spark.createDataFrame([("/home/user/test.go",), ("/nope",)], "path string")
    assert paths(s.contains_paths(search_files, asked)) == ["/home/user/test.go"]
    assert paths(s.get_by_path(search_files, "/nope")) == []


@pytest.mark.parametrize(
    "text, count",
    [
        ("config", 2), ("/home/user", 4), ("exact:config.yaml", 1), ("test ext:.go", 2),
        ("size:>100", 3), ("size:>=100", 4), ("size:<200", 2), ("size:<=200", 3),
        ("size:>100 size:<600 ext:go,txt", 2), ("regex:^test", 2), ("fuzzy:tist.go", 1),
        ("*.md", 1), ("size:<0", 0),
    ],
)
def test_search_text(search_files, text, count):
    assert len(paths(s.search_text(search_files, text))) == count


@pytest.mark.parametrize("text", ["", "   ", "foo:bar", "case:true", "exact:", "regex:[", "a size:5MB", "a size:>x"])
def test_search_text_errors(search_files, text):
    with pytest.raises(ValueError):
        s.search_text(search_files, text)


def test_ranking(catalog, spark):
    df = catalog(("/my_config.txt", 500), ("/config", 200), ("/config.yaml", 1500), ("/readme.md", 300))
    assert names(rank.rank(df, "config")) == ["config", "config.yaml", "my_config.txt", "readme.md"]
    assert [r.score for r in rank.rank(df, "config").collect()] == [110, 55, 35, 10]
    assert names(rank.rank(df)) == ["config", "my_config.txt", "readme.md", "config.yaml"]
    ties = catalog(*[f"/{c}/a.txt" for c in "dbca"])
    assert paths(rank.rank(ties, "a.txt")) == ["/a/a.txt", "/b/a.txt", "/c/a.txt", "/d/a.txt"]
    top = rank.top_k(rank.with_score(df, "config"), 2)
    assert names(top) == ["config", "config.yaml"]
    assert rank.not_shown(df, 3).first().not_shown == 1
    assert rank.not_shown(df, 50).first().not_shown == 0


def test_statistics(catalog, spark):
    df = catalog(("/f1", 100), ("/f2", 200), ("/d", 0, True))
    assert stats.catalog_stats(df).first().asDict() == {
        "file_count": 2, "directory_count": 1, "total_count": 3, "total_size": 300
    }
    big = catalog(("/f", 10), ("/d", 4096, True))
    assert tuple(stats.index_stats(big).first()) == (2, 4106)
    assert tuple(stats.index_stats(big.limit(0)).first()) == (0, 0)
    assert stats.catalog_stats(big.limit(0)).first().total_size == 0
    assert stats.count_regular_files(big).first()["count"] == 1
    tree = catalog("/home/user/a", "/home/user/b", "/home/admin/c", "/home/admin")
    for prefix, count in [("/home/user", 2), ("/home/admin", 2), ("/home", 4), ("/x", 0), ("", 4)]:
        assert stats.prefix_count(tree, prefix).first()["count"] == count
        assert stats.has_prefix(tree, prefix).first().found == (count > 0)
    asked = spark.createDataFrame([("/home/user",), ("/home",), ("/x",), ("",)], "prefix string")
    counts = {r.prefix: r["count"] for r in stats.prefix_counts(tree, asked).collect()}
    assert counts == {"/home/user": 2, "/home": 4, "/x": 0, "": 4}
    assert sorted(r.prefix for r in stats.has_prefixes(tree, asked).collect()) == ["", "/home", "/home/user"]


def test_prefix_counts_without_broadcast(catalog, spark, monkeypatch):
    monkeypatch.setattr(stats, "broadcast_if_small", lambda df, limit: None)
    tree = catalog(*[f"/hot/{i}" for i in range(300)], "/cold/1")
    asked = spark.createDataFrame([("/hot/",), ("/hot/1",), ("/",)], "prefix string")
    counts = {r.prefix: r["count"] for r in stats.prefix_counts(tree, asked).collect()}
    assert counts == {"/hot/": 300, "/hot/1": 111, "/": 301}


def test_prefixes_are_computed_once(catalog, spark):
    """A table of prefixes is measured, sampled and shuffled, but worked out once."""
    tree, seen = catalog("/a/b", "/a/c", "/d"), spark.sparkContext.accumulator(0)

    def noted(prefix):
        seen.add(1)
        return prefix

    asked = spark.createDataFrame([("/a",), ("/x",), (None,)], "p string")
    asked = asked.select(F.udf(noted, "string")("p").alias("prefix"))
    found = {r.prefix: r["count"] for r in stats.prefix_counts(tree, asked, 0).collect()}
    assert found == {"/a": 2, "/x": 0, None: 0}
    assert seen.value == 3


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 1])
def test_prefix_counts_equal_brute_force(spark, broadcast_bytes):
    rng = random.Random(8)
    signs = ["a", "b", "/", "é", "\uffff", "\U0001f600", "\U0010ffff"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 5))) for _ in range(400)]
    texts += ["hot"] * 300 + [None]
    asked = [*["".join(rng.choices(signs, k=rng.randint(0, 3))) for _ in range(150)], "hot", "hott", "", "a", "a"]
    files = spark.createDataFrame([(t, 1) for t in texts], "path string, sign int").repartition(5)
    table = spark.createDataFrame([(p, i) for i, p in enumerate(asked)], "prefix string, key int")
    counts = {p: sum(t is not None and t.startswith(p) for t in texts) for p in asked}
    for rows in (files, files.limit(0)):
        found = stats.prefix_counts(rows, table, broadcast_bytes).collect()
        assert {r.prefix: r["count"] for r in found} == (counts if rows is files else dict.fromkeys(counts, 0))
        assert len(found) == len(counts)
    there = stats.has_prefixes(files, table, broadcast_bytes).collect()
    assert sorted(r.key for r in there) == [i for i, p in enumerate(asked) if counts[p]]
    assert stats.prefix_counts(files, table.limit(0), broadcast_bytes).count() == 0
    unknown = spark.createDataFrame([(None,), ("hot",)], "prefix string")
    assert {r.prefix: r["count"] for r in stats.prefix_counts(files, unknown, broadcast_bytes).collect()} == {None: 0, "hot": 300}


def test_large_prefix_tables_shuffle_each_path_once(catalog, spark):
    asked = spark.createDataFrame([("/a",), ("/b",)], "prefix string")
    plan = stats._ranks(catalog("/a/1", "/b/2"), asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == plan.count("Exchange") == 1
    assert plan.count("Generate") == 1  # the two ends of a prefix; paths are not taken apart


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, raw string")
    return validate_queries(parse_queries(df))


def test_query_types(spark):
    texts = [
        "config", "/home/user", "\\temp", "test*.txt", "file?.md", "regex:test[0-9]+", "fuzzy:cofig",
        "exact:config.yaml", "test config", "a regex:b", "regex:a b", "FUZZY:x y",
    ]
    rows = parsed(spark, texts).orderBy("query_id").collect()
    assert [(r.type, r.pattern) for r in rows] == [
        ("substring", "config"), ("prefix", "/home/user"), ("prefix", "\\temp"),
        ("wildcard", "test*.txt"), ("wildcard", "file?.md"), ("regex", "test[0-9]+"),
        ("fuzzy", "cofig"), ("exact", "config.yaml"), ("substring", "test config"),
        ("substring", "a"), ("regex", "a b"), ("substring", "y"),
    ]


def test_query_options(spark):
    texts = [
        "x ext:.go,txt, ext:md,,", "x size:>1KB size:>=2KB size:<10KB", "x case:True case:false",
        "fuzzy:x fuzzy:9", "fuzzy:x fuzzy:0 fuzzy:abc", "x fuzzy:9", "config\text:.yaml\nsize:>1KB",
        "x size:>5 size:<=3", "x ext:", "x EXTENSION:go SIZE:<=1.5kb",
    ]
    rows = parsed(spark, texts).orderBy("query_id").collect()
    assert rows[0].extensions == [".md"]
    assert (rows[1].min_size, rows[1].max_size) == (2048, 10239)
    assert rows[2].case_sensitive is False
    assert [r.fuzzy_distance for r in rows[3:6]] == [5, 1, 9]
    assert (rows[6].pattern, rows[6].extensions, rows[6].min_size) == ("config", [".yaml"], 1025)
    assert rows[7].error == "least size 6 is above largest size 3"
    assert rows[8].extensions == [] and rows[8].error is None
    assert (rows[9].extensions, rows[9].max_size) == ([".go"], 1536)


def test_query_errors(spark):
    texts = [None, "", " \t", "a size:5MB", "a size:>x size:<y", "case:true", "ext:", "regex:[", r"regex:(a)\1", "exact:"]
    rows = parsed(spark, texts).orderBy("query_id").collect()
    assert [r.error for r in rows] == [
        "nothing is asked for", "nothing is asked for", "nothing is asked for",
        "not a size: 5MB", "not a size: >x", "there is no pattern",
        "there is no pattern", "this regex cannot be used", "this regex cannot be used",
        "there is no pattern",
    ]


def byte_distance(a, b):
    a, b = a.encode(), b.encode()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def random_words(seed, count, alphabet="abcé"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(count)})


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_fuzzy_join_equals_brute_force(spark, distance):
    left, right = random_words(distance, 220), random_words(distance + 100, 90)
    found = fuzzy_join(
        spark.createDataFrame([(w,) for w in left], "name string"),
        spark.createDataFrame([(w,) for w in right], "pattern string"),
        distance,
    )
    wanted = {(a, b) for a in left for b in right if byte_distance(a, b) <= distance}
    rows = [(r.name, r.pattern) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == wanted


REGEX_PARTS = {
    r"^CHAP.*\.(tex|bib)$": [(".bib", ".tex"), ("CHAP",)], "(north|south)[0-9]": [("north", "south")], "pages[0-9]+": [("pages",)],
    "gr[ae]y": [("gray", "grey")], "ab*cde": [("a",), ("cde",)], "x{2}yz": [("xxyz",)], "a|bcd": [("a", "bcd")],
    "(?i)Atlas": [("atlas",)], "(?i)é+a": [("a",)], r"\x41bc": [], r"\pLabc": [], "(ab(cd)?)+ef": [("ab", "abcd"), ("ef",)],
    r"a\.bcd": [("a.bcd",)], "[a-z]+": [], "[]a]bc": [("]bc", "abc")], r"\\xyz": [("\\xyz",)], "[[:alpha:]]abc": [("abc",)],
    "[0-9]{4}?": [], "ab{1,2}?cd": [("a",), ("b",), ("cd",)], "x*?yz": [("yz",)], "abc??d": [("abcd", "abd")], r"\Qa+\E+": [],
    "(a|)": [], "(abc)*": [], "(?:m(?P<x>n|o)p|qrs)t": [("mnpt", "mopt", "qrst")], "f(?i)oo": [], "(" * 2000 + "a" + ")" * 2000: [],
}


def test_required_parts_of_regex():
    assert {r: required_parts(r) for r in REGEX_PARTS} == REGEX_PARTS
    assert required_parts(None) == required_parts("") == []


def random_regex(rng, depth=0):
    def item():
        kind = rng.randrange(9)
        if kind < 4 or depth > 2:
            return rng.choice("abAB") + rng.choice(["", "", "b", "ab"])
        if kind < 6:
            return f"({random_regex(rng, depth + 1)})"
        return rng.choice([".", "[ab]", "[^a]", r"\w", r"\.", r"\Qa.\E", "[[:upper:]]", "^", "$"])

    branches = [
        "".join(item() + rng.choice(["", "", "", "?", "*", "+", "{2}", "{1,2}", "+?"]) for _ in range(rng.randrange(1, 4)))
        for _ in range(rng.choice([1, 1, 2, 3]))
    ]
    return "|".join(branches)


def test_matches_have_a_text_of_each_part(spark):
    rng = random.Random(21)
    regexes = [rng.choice(["", "", "(?i)"]) + random_regex(rng) for _ in range(700)]
    names = ["".join(rng.choice("abAB.") for _ in range(rng.randrange(7))) for _ in range(80)]
    df = spark.createDataFrame([(r,) for r in regexes], "r string").filter(regex.is_valid(F.col("r")))
    held = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.rlike(n, F.col("java")))
    found = df.withColumn("java", regex.to_java(F.col("r"))).select("r", held.alias("held")).collect()
    assert len(found) > 400 and sum(len(r.held) for r in found) > 5000
    with_parts = 0
    for row in found:
        parts = required_parts(row.r)
        with_parts += len(parts) > 0
        for name in row.held:
            text = name.lower() if row.r.startswith("(?i)") else name
            assert all(any(t in text for t in part) for part in parts), (row.r, name, parts)
    assert with_parts > 200


def test_size_cells(spark):
    edge, rng = (1 << 63) - 1, random.Random(4)
    ranges = [(None, None), (0, edge), (-edge - 1, edge), (edge, edge), (5, 4), (None, 7), (7, None), (0, 0), (-3, -1)]
    ranges += [tuple(sorted(rng.choices(range(-40, 200), k=2))) for _ in range(60)]
    ranges += [tuple(sorted(rng.choices(range(-edge, edge, 99991), k=2))) for _ in range(40)]
    df = spark.createDataFrame(ranges, "min_size long, max_size long").selectExpr("*", f"{size_cells()} AS cells")
    for lo, hi, cells in df.collect():
        if lo is None and hi is None:
            assert [tuple(c) for c in cells] == [(batch_search.WHOLE, 0)]
            continue
        lo, hi = -edge - 1 if lo is None else lo, edge if hi is None else hi
        spans = sorted((c << level, ((c + 1) << level) - 1) for level, c in cells)
        assert len(spans) <= 126
        if lo > hi:
            assert spans == []
            continue
        assert spans[0][0] == lo and spans[-1][1] == hi
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_regex_dialect(spark, catalog):
    df = catalog("/log2024.txt", "/aab", "/x+*y", "/abc.go", "/[:a", "/A B")
    for pattern, wanted in {
        "[[:digit:]]": ["log2024.txt"], "[[:^alpha:]]": ["A B", "[:a", "abc.go", "log2024.txt", "x+*y"],
        "[*+]": ["x+*y"], r"\++\*+": ["x+*y"], "a{2}?b": ["aab"], "[[:space:][:digit:]]": ["A B", "log2024.txt"],
        "[" + "q" * 200 + "[:digit:]]": ["log2024.txt"], "[" + "q" * 20000 + "&&[:digit:]]": ["log2024.txt"], "[[]:a": ["[:a"], "[^]a-z0-9.]": ["A B", "[:a", "x+*y"],
        "(?U)a+b": ["aab", "abc.go"], "(?Ui)A+B": ["aab", "abc.go"], r"\Q+*\E": ["x+*y"], "[[:word:]]b": ["aab", "abc.go"],
    }.items():
        assert sorted(r.name for r in s.search_regex(df, pattern).collect()) == wanted, pattern
    for pattern in ("a++", "a*+b", "(?=a)", r"(a)\1", "(?>a)", "[", r"\h", "(?x)a", "[[:digit:]", r"\R"):
        with pytest.raises(ValueError):
            s.search_regex(df, pattern)


MANY_TEXTS = [
    "config", "CONFIG case:true", "/home/u1", "/", "*.txt", "?????", "*", "regex:^[a-z]+$", r"regex:fig\.(go|txt)$",
    "fuzzy:config.go", "fuzzy:konfig fuzzy:1", "fuzzy:README.md case:true fuzzy:5", "exact:readme.md", "exact:README.md case:true",
    "size:>100", "size:<=100 ext:go", "ext:txt,md", "config size:>50 size:<2KB ext:go,txt", "a", "zz", "co", "config",
    "regex:.", "fuzzy:ab fuzzy:3", "size:>10 size:<5", "", "regex:[", "read?e*", "regex:n{1}?f", "regex:[*+]", "regex:[[:upper:]]",
    "regex:[^[:lower:][:punct:]]", r"regex:\.+", "regex:(?U)o.*g", "regex:a++", "size:>9223372036854775807",
    "size:<=9223372036854775807 ext:md", "fuzzy:readme.md fuzzy:9",
]


@pytest.fixture(scope="module")
def many_files(catalog):
    rng = random.Random(7)
    stems = ["config", "Config", "konfig", "README", "readme", "a", "ab", "main", "co"]
    ends = ["", ".go", ".txt", ".md", ".GO"]
    rows = []
    for i in range(400):
        name = rng.choice(stems) + rng.choice(ends) if rng.random() < 0.7 else "config.go"
        size = rng.choice([0, 5, 51, 100, 101, 1023, 1024, 2048, 1 << 20])
        rows.append((f"/home/u{i % 7}/{i}/{name}", size, rng.random() < 0.1))
    return catalog(*rows)


@pytest.fixture(scope="module")
def single_results(many_files):
    found = {}
    for number, text in enumerate(MANY_TEXTS):
        try:
            rows = s.search_text(many_files, text).collect()
        except ValueError:
            rows = []
        found[number] = [(r.path, r.score) for r in rows]
    found[MANY_TEXTS.index("size:>10 size:<5")] = []
    return found


@pytest.mark.parametrize(
    "broadcast_bytes, k, literals", [(32 << 20, 10, 64), (32 << 20, 10, 6), (1, 10, 64), (32 << 20, 2000, 6), (1, 2000, 6)]
)
def test_search_many_equals_single_searches(spark, many_files, single_results, monkeypatch, broadcast_bytes, k, literals):
    monkeypatch.setattr(batch_search, "LITERALS", literals)
    by_query = {}
    for row in search_many(many_files, parsed(spark, MANY_TEXTS), k, broadcast_bytes).collect():
        by_query.setdefault(row.query_id, []).append((row["rank"], row.path, row.score))
    for number, text in enumerate(MANY_TEXTS):
        ranked = [(path, score) for _, path, score in sorted(by_query.get(number, []))]
        assert ranked == single_results[number][:k], text


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 1])
def test_search_many_ranks_prefixes_of_relative_paths(spark, catalog, broadcast_bytes):
    df = catalog("co/a/x", "co/b/y", "co/c/co", "co/d/cobra", "co", "coat", "x/co", "Co/co")
    queries = parsed(spark, ["co"]).withColumn("type", F.lit("prefix"))
    for k in (1, 2, 3, 10):
        many = search_many(df, queries, k, broadcast_bytes).orderBy("rank")
        assert paths(many) == paths(s.search(df, SearchSpec("prefix", "co"), k))


def test_search_many_with_nothing_to_do(spark, many_files):
    assert search_many(many_files, parsed(spark, ["", "regex:["]), 5).count() == 0
    assert search_many(many_files.limit(0), parsed(spark, MANY_TEXTS), 5).count() == 0


def test_first_rows_of_much_alike_groups(spark, capsys):
    """A number in front of the keys spares comparisons and changes no row."""
    rows = [((None, ".a", ".b")[i % 3], (i % 5, i % 2), f"/{(i * 7919) % 400}") for i in range(1200)]
    df = spark.createDataFrame(rows, "extension string, place struct<level: int, cell: long>, path string")
    plain, numbered = (
        first_k_per(df, ["extension", "place"], ["path"], 4, "n", much_alike=a) for a in (False, True)
    )
    shown = lambda found: sorted((r.extension or "", r.place, r.path, r.n) for r in found.collect())
    assert shown(numbered) == shown(plain) and plain.count() == 30 * 4
    numbered.explain()
    assert "xxhash64(extension" in capsys.readouterr().out



def test_search_many_with_many_size_ranges(spark, many_files):
    texts = [f"size:>={n} size:<={n * 3}" for n in range(1, 40)] + [f"config size:>{n}" for n in range(9)]
    texts += [f"/home/u{n} size:<{n * 300}" for n in range(7)] + ["config size:<2KB", "config size:>=1KB", "config size:>1KB"]
    by_query = {}
    for row in search_many(many_files, parsed(spark, texts), 5, 1).collect():
        by_query.setdefault(row.query_id, []).append((row["rank"], row.path, row.score))
    for number in range(0, len(texts), 5):
        wanted = [(r.path, r.score) for r in s.search_text(many_files, texts[number], 5).collect()]
        assert [(path, score) for _, path, score in sorted(by_query.get(number, []))] == wanted, texts[number]
    few = plan_of(search_many(many_files, parsed(spark, texts), 5, 1))
    many = plan_of(search_many(many_files, parsed(spark, [*texts, *(f"size:>{n * 77}" for n in range(400))]), 5, 1))
    assert many.count("Window") == few.count("Window")


UNKEYED = ["*", "?????", "????.*", "regex:^[0-9a-c]+", "regex:.", "regex:^.{3,4}$", "*?* ext:go", "??????* case:true", "regex:[[:upper:]]", "regex:$"]


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 1])
def test_patterns_without_text_meet_names_in_blocks(spark, many_files, monkeypatch, broadcast_bytes):
    texts = [*UNKEYED, *(f"regex:^.{{{n}}}$" for n in range(70))]
    direct = {}
    for number in range(0, len(texts), 4):
        direct[number] = [(r.path, r.score) for r in s.search_text(many_files, texts[number], 8).collect()]
    monkeypatch.setattr(batch_search, "NAMES_PER_BLOCK", 7)
    monkeypatch.setattr(batch_search, "PATTERNS_PER_BLOCK", 9)
    by_query = {}
    many = search_many(many_files, parsed(spark, texts), 8, broadcast_bytes)
    assert "{13}" not in plan_of(many)
    for row in many.collect():
        by_query.setdefault(row.query_id, []).append((row["rank"], row.path, row.score))
    for number, wanted in direct.items():
        assert [(path, score) for _, path, score in sorted(by_query.get(number, []))] == wanted, texts[number]


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 1])
def test_alternatives_are_keyed(spark, many_files, monkeypatch, broadcast_bytes):
    """Regexes with groups and alternatives meet names by pieces, and each match once."""
    monkeypatch.setattr(batch_search, "LITERALS", 0)
    monkeypatch.setattr(batch_search, "_match_blocks", None)
    texts = [r"regex:(config|readme)[.](go|md)", "regex:(a|ab|main)$", "regex:(?i)(CONFIG|konf)ig?", "regex:co(nf)?", "*fig*.g?", "*a*n*"]
    by_query = {}
    for row in search_many(many_files, parsed(spark, texts), 500, broadcast_bytes).collect():
        by_query.setdefault(row.query_id, []).append((row["rank"], row.path, row.score))
    for number, text in enumerate(texts):
        wanted = [(r.path, r.score) for r in s.search_text(many_files, text, 500).collect()]
        assert wanted and [(path, score) for _, path, score in sorted(by_query[number])] == wanted, text


def test_hot_keys_are_sliced(spark):
    from shelfmark.plans.sizing import hot_keys, join_hot_keys

    many = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id)) AS key", "id")
    few = spark.range(5).selectExpr("IF(id < 3, 'hot', concat('k', id)) AS key", "id AS other")
    assert [tuple(r) for r in hot_keys(many, "key", 100).collect()] == [("hot", 10)]
    plain = sorted(map(tuple, many.join(few, "key").collect()))
    sliced = join_hot_keys(many, few, "key", rows_per_task=100, broadcast_bytes=0)
    assert sorted(map(tuple, sliced.collect())) == plain and len(plain) == 3001


@pytest.mark.parametrize("distance", [1, 4])
def test_fuzzy_join_of_large_tables(spark, monkeypatch, distance):
    """Neither side broadcast, no literal keys, hot keys cut into slices."""
    from shelfmark.operators import fuzzy_join as module
    from shelfmark.plans import sizing

    left, right = random_words(1, 300, "ab"), random_words(2, 80, "ab")
    names = spark.createDataFrame([(w, w) for w in left], "name string, text string")
    patterns = spark.createDataFrame([(w, w, distance) for w in right], "pattern string, text string, distance int")
    monkeypatch.setattr(sizing, "LITERAL_KEYS", 3)
    monkeypatch.setattr(module, "join_hot_keys", lambda *a, **k: sizing.join_hot_keys(*a, rows_per_task=20, **k))
    found = module.close_pairs(names, patterns, broadcast_bytes=1).collect()
    wanted = {(a, b) for a in left for b in right if byte_distance(a, b) <= distance}
    assert len(found) == len(wanted) and {(r.name, r.pattern) for r in found} == wanted


def test_saved_catalogs_skip_by_path(spark, catalog, tmp_path):
    from shelfmark.sources.snapshot import load_catalog, save_catalog

    folder = str(tmp_path / "catalog")
    save_catalog(catalog(*[f"/d{i % 10}/{i:04}" for i in range(2000)]), folder, partitions=5)
    saved = load_catalog(spark, folder)
    for found, count in ((s.search_prefix(saved, "/d3/", ordered=False), 200), (s.get_by_path(saved, "/d7/0007"), 1)):
        plan = found._jdf.queryExecution().executedPlan()
        assert plan.execute().count() == count
        scanned = plan.collectLeaves().apply(0).metrics().get("numOutputRows").get().value()
        # The bounds between the five files are sampled: at most two of them hold the prefix.
        assert count <= scanned <= 1400


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_plans(spark, many_files, tmp_path):
    from shelfmark.functions import predicates as p
    from shelfmark.sources.snapshot import load_catalog, save_catalog

    folder = str(tmp_path / "catalog")
    save_catalog(many_files, folder)
    saved = load_catalog(spark, folder)
    assert "StringStartsWith(path,/home/u1)" in plan_of(s.search_prefix(saved, "/home/u1"))
    assert "EqualTo(path,/a)" in plan_of(s.get_by_path(saved, "/a"))
    assert "In(extension, [.go,.txt])" in plan_of(s.search_extensions(saved, ["go", "txt"]))
    assert "GreaterThanOrEqual(size,100)" in plan_of(saved.filter(p.min_size(100)))
    assert "StringStartsWith(name,con)" in plan_of(s.search_wildcard(saved, "con*", True))
    assert "StringContains(name,con)" in plan_of(s.search_substring(saved, "con", True))
    top = plan_of(s.search(saved, SearchSpec("substring", "config", extensions=[".go"]), 50))
    assert "TakeOrderedAndProject" in top and "Exchange" not in top
    counted = plan_of(stats.prefix_count(saved, "/home"))
    assert "ReadSchema: struct<path:string>" in counted
    many = plan_of(search_many(saved, parsed(spark, MANY_TEXTS), 10))
    assert "WindowGroupLimit" in many
    for plan in (many, plan_of(search_many(saved, parsed(spark, MANY_TEXTS), 10, 1))):
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "PythonUDF" not in plan


@pytest.mark.parametrize("broadcast_bytes", [1, 32 << 20])
def test_fuzzy_join_reads_its_patterns_once(spark, broadcast_bytes):
    """Patterns can be costly to make, and come in one file: each is made once, keys by several tasks."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(number):
        seen.add(1)
        return f"report_{number}.txt"

    patterns = spark.range(40).coalesce(1).select(made("id").alias("text"), F.lit(1).alias("distance"))
    patterns = patterns.withColumn("pattern", F.concat("text", F.lit("")))
    names_ = spark.createDataFrame([("report_1.txt", "report_1.txt"), ("report_x.txt", "report_x.txt")], "name string, text string")
    found = close_pairs(names_, patterns, broadcast_bytes).select("name").collect()
    # The distances are looked for first.
    assert len(found) > 10 and seen.value <= 80
    seen.value = 0
    close_pairs(names_, patterns, broadcast_bytes, [1]).collect()
    assert seen.value <= 40
