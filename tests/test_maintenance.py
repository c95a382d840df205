import gzip
import json
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import merge
from shelfmark.schema import CATALOG_COLUMNS, catalog_from_manifest
from shelfmark.sources import change_log, json_document, listing, snapshot
from shelfmark.streaming import debounce as d, maintain
from tests.conftest import paths

START = datetime(2024, 1, 1)
CHANGE_SCHEMA = (
    "seq long, ts timestamp, path string, op string, size long, modified_time timestamp, is_dir boolean"
)


def rows_of(df):
    return sorted(map(tuple, df.select(*CATALOG_COLUMNS).collect()))


def sizes(df):
    return {r.path: r.size for r in df.collect()}


def changes(spark, *rows):
    """Changes from ``(seconds, path, op, size)``; the position is the sequence number."""
    full = [
        (i, START + timedelta(seconds=seconds), path, op, size, START, False)
        for i, (seconds, path, op, size) in enumerate(rows)
    ]
    return spark.createDataFrame(full, CHANGE_SCHEMA)


def test_catalog_from_manifest(spark):
    rows = [("/a/b.go", 5, START, False), (None, 1, START, False), ("", 1, START, False), ("/d", None, START, None)]
    df = spark.createDataFrame(rows, "key string, bytes long, at timestamp, folder boolean")
    made = catalog_from_manifest(df, "key", "bytes", "at", "folder")
    assert rows_of(made) == [
        ("/a/b.go", "b.go", 5, START, False, ".go"), ("/d", "d", 0, START, False, "")
    ]


@pytest.mark.parametrize("small", [True, False])
def test_upsert_update_remove(catalog, spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(merge, "broadcast_if_small", lambda df: None)
    df = catalog(("/a", 1), ("/b", 2), ("/b/c", 3, True))
    given = [("/a", 10, START, False, 1), ("/a", 11, START, False, 2), ("/new", 5, START, False, 3), ("", 9, START, False, 4)]
    rows = spark.createDataFrame(given, "path string, size long, modified_time timestamp, is_dir boolean, seq long")
    rows = catalog_from_manifest(rows, keep=["seq"])
    assert sizes(merge.upsert(df, rows, ["seq"])) == {"/a": 11, "/b": 2, "/b/c": 3, "/new": 5}
    updated, report = merge.update_existing(df, rows, ["seq"])
    assert sizes(updated) == {"/a": 11, "/b": 2, "/b/c": 3}
    assert {r.path: r.found for r in report.collect()} == {"/a": True, "/new": False}
    gone = spark.createDataFrame([("/b",), ("/b",), ("/x",)], "path string")
    removed = merge.remove(df, gone)
    assert sizes(removed) == {"/a": 1, "/b/c": 3}
    assert rows_of(merge.remove(removed, gone)) == rows_of(removed)
    assert {r.path: r.found for r in merge.found_report(df, gone).collect()} == {"/b": True, "/x": False}


def test_steps_are_deleted(catalog, spark, tmp_path):
    import os

    from shelfmark.operators.batch_search import search_many
    from shelfmark.operators.query_table import parse_queries
    from shelfmark.plans import storage

    storage.delete_steps(spark)
    texts = spark.createDataFrame([(1, "a"), (2, "fuzzy:b.go"), (3, "size:>0")], "query_id long, raw string")
    files = catalog(*[(f"/{c}.go", 1) for c in "abc"])
    found = search_many(files, parse_queries(texts), 5, broadcast_bytes=0).collect()
    shared = storage.shared_folder(spark).removeprefix("file:")
    steps = [n for n in os.listdir(shared) if n.startswith("step-")]
    assert found and steps
    assert storage.delete_steps(spark) == len(steps)
    assert not [n for n in os.listdir(shared) if n.startswith("step-")]
    assert storage.delete_steps(spark) == 0


def test_union_last_wins(catalog):
    merged = merge.union_last_wins([catalog(("/a", 1), ("/b", 1)), catalog(("/b", 2)), catalog(("/c", 3), ("/a", 9))])
    assert sizes(merged) == {"/a": 9, "/b": 2, "/c": 3}


def test_apply_changes(catalog, spark):
    df = catalog(("/keep", 1), ("/mod", 1), ("/del", 1), ("/ren", 1), ("/gone", 1), ("/stale", 1))
    log = changes(
        spark, (1, "/mod", "modify", 5), (2, "/del", "delete", None), (3, "/ren", "rename", None),
        (4, "/new", "create", 7), (5, "/gone", "delete", None), (6, "/gone", "create", None),
        (7, "/stale", "modify", None), (8, "/back", "delete", None), (9, "/back", "create", 3),
        (9, "/mod", "modify", 6), (10, "/never", "delete", None),
    )
    wanted = {"/keep": 1, "/mod": 6, "/new": 7, "/stale": 1, "/back": 3}
    assert sizes(merge.apply_changes(df, log)) == wanted
    assert sizes(merge.apply_changes(df, log.repartition(7, "op"))) == wanted


def one_by_one(catalog_sizes, log):
    state = dict(catalog_sizes)
    for _, path, op, size in sorted(log, key=lambda c: c[0]):
        if op in ("delete", "rename"):
            state.pop(path, None)
        elif size is not None:
            state[path] = size
    return state


def test_apply_changes_equals_one_by_one(catalog, spark):
    rng = random.Random(3)
    log = [
        (i, f"/p{rng.randint(0, 25)}", rng.choice(["create", "modify", "delete", "rename"]), rng.choice([None, i]))
        for i in range(300)
    ]
    start = {f"/p{i}": 1000 + i for i in range(0, 30, 2)}
    df = catalog(*start.items())
    assert sizes(merge.apply_changes(df, changes(spark, *log))) == one_by_one(start, log)


def test_raw_changes(spark):
    raw = [
        (1, START, "/a.txt", ["write", "create"], 5, START, False), (2, START, "/a.txt", ["chmod"], 5, START, False),
        (3, START, "/b", ["rename", "remove"], None, None, None), (4, START, "/x.tmp", ["create"], 1, START, False),
    ]
    df = spark.createDataFrame(raw, change_log.RAW_SCHEMA)
    mapped = change_log.map_raw_changes(change_log.filter_ignored(df)).orderBy("seq").collect()
    assert [(r.path, r.op) for r in mapped] == [
        ("/a.txt", "create"), ("/a.txt", "modify"), ("/b", "delete"), ("/b", "delete")
    ]


def test_debounce_of_bursts(spark):
    delay = timedelta(milliseconds=50)
    burst = changes(spark, (0, "/a", "modify", 1), (0.01, "/a", "modify", 2), (0.02, "/a", "delete", 3))
    row = d.debounce(burst, delay).collect()
    assert [(r.op, r.size, r.ts) for r in row] == [("delete", 3, START + timedelta(milliseconds=20))]
    assert row[0].settled_at == START + timedelta(milliseconds=70)
    three = changes(spark, (0, "/a", "create", 1), (0, "/b", "create", 1), (0, "/c", "create", 1))
    assert d.debounce(three, delay).count() == 3
    exact = changes(spark, (0, "/a", "create", 1), (0.05, "/a", "modify", 1), (0.100001, "/a", "modify", 1))
    assert d.debounce(exact, delay).count() == 2


def sessions(log, delay):
    """The expected sessions, path by path."""
    found = []
    for path in {p for _, p, _ in log}:
        times = sorted((ts, seq) for ts, p, seq in log if p == path)
        for here, after in zip(times, times[1:] + [None]):
            if after is None or after[0] - here[0] > delay:
                found.append((path, here[0], here[1]))
    return sorted(found)


@pytest.mark.parametrize("blocks, origin", [(4096, START), (3, START), (1, datetime(1969, 12, 31, 23, 59, 30))])
def test_debounce_equals_naive_sessions(spark, monkeypatch, blocks, origin):
    monkeypatch.setattr(d, "CELLS_PER_BLOCK", blocks)
    rng = random.Random(blocks)
    log = [
        (origin + timedelta(milliseconds=rng.choice([100, 250, 1000]) * rng.randint(0, 120)), f"/p{rng.randint(0, 3) and 0}", i)
        for i in range(400)
    ] + [(origin + timedelta(milliseconds=rng.randint(0, 60_000)), f"/q{i % 9}", 1000 + i) for i in range(300)]
    df = spark.createDataFrame([(i, ts, p, "modify", 1, START, False) for ts, p, i in log], CHANGE_SCHEMA)
    for delay in (timedelta(milliseconds=100), timedelta(milliseconds=700), timedelta(seconds=5)):
        found = sorted((r.path, r.ts, r.seq) for r in d.debounce(df, delay).collect())
        assert found == sessions(log, delay)


def test_pending_flush_discard(spark):
    delay = timedelta(seconds=10)
    log = changes(
        spark, (0, "/a", "create", 1), (25, "/a", "delete", None), (21, "/b", "modify", 2),
        (20, "/c", "create", 3), (5, "/d", "create", 4), (31, "/e", "create", 5),
    )
    as_of = START + timedelta(seconds=30)
    assert d.pending(log, delay, as_of).first().pending == 2
    flushed = {r.path: r.op for r in d.flush(log, delay, as_of).collect()}
    assert flushed == {"/a": "delete", "/b": "modify"}
    settled = {(r.path, r.op) for r in d.discard_pending(log, delay, as_of).collect()}
    assert settled == {("/a", "create"), ("/c", "create"), ("/d", "create")}


def test_snapshot_round_trip(catalog, spark, tmp_path):
    folder = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        snapshot.load_catalog(spark, folder)
    snapshot.clear_catalog(spark, folder)
    df = catalog(*[(f"/d/{i}.txt", i) for i in range(1000)], ("/d", 0, True))
    manifest = snapshot.save_catalog(df, folder, partitions=3)
    assert (manifest.version, manifest.file_count, manifest.total_size) == ("1.0", 1001, 499500)
    loaded = snapshot.load_catalog(spark, folder)
    assert rows_of(loaded) == rows_of(df)
    parts = loaded.select(F.spark_partition_id().alias("p"), F.input_file_name().alias("f"), "path").groupBy("f").agg(
        F.min("path").alias("lo"), F.max("path").alias("hi")
    ).orderBy("lo").collect()
    assert len(parts) == 3 and all(a.hi < b.lo for a, b in zip(parts, parts[1:]))
    snapshot.validate_catalog(spark, folder)
    copy = snapshot.backup_catalog(spark, folder, datetime(2025, 1, 15, 10, 30))
    assert copy == folder + ".backup.20250115_103000"
    snapshot.save_catalog(df.limit(3), folder)
    assert snapshot.load_catalog(spark, folder).count() == 3
    assert rows_of(snapshot.load_catalog(spark, copy)) == rows_of(df)
    snapshot.clear_catalog(spark, folder)
    snapshot.clear_catalog(spark, folder)
    assert snapshot.load_catalog(spark, folder).count() == 0
    with pytest.raises(FileNotFoundError):
        snapshot.backup_catalog(spark, str(tmp_path / "none"))


def test_snapshot_can_be_rewritten_from_itself(catalog, spark, tmp_path):
    folder = str(tmp_path / "c")
    snapshot.save_catalog(catalog(("/a", 1), ("/b", 2)), folder)
    gone = spark.createDataFrame([("/a",)], "path string")
    snapshot.save_catalog(merge.remove(snapshot.load_catalog(spark, folder), gone), folder)
    assert sizes(snapshot.load_catalog(spark, folder)) == {"/b": 2}


def test_damaged_snapshots(catalog, spark, tmp_path):
    def with_manifest(name, change):
        folder = str(tmp_path / name)
        manifest = snapshot.save_catalog(catalog(("/a", 1), ("/b", 2)), folder).asDict()
        manifest["number"] += 1
        snapshot._publish(spark, folder, {**manifest, **change})
        return folder

    with pytest.raises(ValueError, match="format 2.0"):
        snapshot.load_catalog(spark, with_manifest("v", {"version": "2.0"}))
    with pytest.raises(ValueError, match="5 files were recorded and 2"):
        snapshot.validate_catalog(spark, with_manifest("n", {"file_count": 5}))
    folder = str(tmp_path / "twice")
    saved = snapshot.save_catalog(catalog(("/a", 1), ("/b", 2)), folder)
    catalog(("/a", 1), ("/a", 2)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/data/{saved.data}")
    with pytest.raises(ValueError, match="path is repeated: /a"):
        snapshot.validate_catalog(spark, folder)


def document(names, separators=None, **change):
    """A snapshot document in the compact form, or with other separators."""
    files = [
        {"path": f"/{name}", "name": name, "size": size, "modified_time": "2024-01-01T00:00:00Z", "is_dir": False, "extension": ".txt"}
        for size, name in enumerate(names, 1)
    ]
    body = {"version": "1.0", "created_at": "2024-01-01T00:00:00Z", "file_count": len(files), "files": files, "total_size": 6, "compressed": False}
    return json.dumps({**body, **change}, separators=separators or (",", ":"), ensure_ascii=False) + "\n"


@pytest.mark.parametrize("separators", [None, (", ", ": ")])
def test_import_json(spark, tmp_path, separators):
    plain, packed = tmp_path / "s.json", tmp_path / "s.json.gz"
    odd = ['a},{"path":"b.txt', "c}],x.txt", "d\ne.txt", "ü},{.txt", ',"files":[{"path":f.txt']
    for names in (["a.txt"], ["a.txt", "b.txt"], ["a.txt", "b.txt", "a.txt"], odd, [f"{i}.txt" for i in range(500)]):
        text = document(names, separators)
        plain.write_text(text)
        packed.write_bytes(gzip.compress(text.encode()))
        for file in (plain, packed):
            df = snapshot.import_json(spark, str(file))
            assert sizes(df) == {f"/{name}": size for size, name in enumerate(names, 1)}
            assert df.count() == len(set(names)) and df.first().modified_time == START
    plain.write_text(document([], separators))
    assert snapshot.import_json(spark, str(plain)).count() == 0
    for change in ({"version": "9"}, {"file_count": 7}):
        plain.write_text(document(["a.txt", "b.txt"], separators, **change))
        with pytest.raises(ValueError):
            snapshot.import_json(spark, str(plain))
    plain.write_text("not json")
    with pytest.raises(ValueError):
        snapshot.import_json(spark, str(plain))


def test_pieces_of_a_document_are_neither_shuffled_nor_held(spark, tmp_path, capsys):
    for number in range(3):
        entries = [{"path": "/}\\\"" * (i % 2), "name": "\"{[" * (i % 3), "size": i} for i in range(40)]
        (tmp_path / f"part-{number}").write_text(json.dumps(entries) + "\n")
    read = json_document._for_both_beginnings(json_document.split_document(spark, str(tmp_path)))
    read.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    wanted = sorted(tuple(r) for r in read.collect())
    assert sum(r[-1] for r in wanted) == len({r[:2] for r in wanted})
    for rows in (1, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            assert sorted(tuple(r) for r in read.select("*").collect()) == wanted
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Both beginnings, counted by hand: pieces of a file in order.
    for number in range(3):
        file = [r for r in wanted if r[0].endswith(f"part-{number}")]
        quotes = 0
        for r in sorted(file, key=lambda r: r[2]):
            assert r[7] == quotes % 2
            quotes += re.sub(r"(?s)\\.", "", r[4]).count('"')



def test_import_json_is_read_in_parallel(spark, tmp_path):
    file = tmp_path / "s.json"
    file.write_text(document([f"{i}.txt" for i in range(20_000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300_000)
    try:
        df = snapshot.import_json(spark, str(file))
        assert json_document.split_document(spark, str(file)).rdd.getNumPartitions() > 3
        assert df.count() == 20_000 and df.agg(F.sum("size")).first()[0] == 20_000 * 20_001 // 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("bytes_per_block, indent", [(200, None), (700, 3), (1 << 20, 0)])
def test_documents_of_any_layout(spark, tmp_path, bytes_per_block, indent):
    """Names of braces, brackets, quotes and backslashes, cut into blocks at any place."""
    rng = random.Random(indent or 7)
    signs = ["{", "}", "[", "]", '"', "\\", ",", ":", "\n", "é", "a", '"files":[', "},{"]
    names = ["".join(rng.choices(signs, k=rng.randint(1, 9))) for _ in range(40)]
    body = json.loads(document(names))
    body["files"][3]["extra"] = {"more": [1, {"deep": "}"}]}
    body["files"][5] = dict(reversed(body["files"][5].items()))
    late = {"options": {"a": ["}", {"b": "]"}]}, **{k: body.pop(k) for k in ("version", "file_count")}}
    file = tmp_path / "s.json"
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_per_block)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        for end in ("", " \n\n"):
            file.write_text(json.dumps({**body, **late}, indent=indent, ensure_ascii=False) + end)
            wanted = {f"/{name}": size for size, name in enumerate(names, 1)}
            assert sizes(snapshot.import_json(spark, str(file))) == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_documents_in_parts(spark, tmp_path):
    text = document(["a}.txt", "b.txt", "c.txt"])
    folder = tmp_path / "parts"
    folder.mkdir()
    lines = text.replace(',"files":[', ',"files":[\n').replace("},{", "},\n{").replace("}],", "}\n],").replace('"is_dir"', '\n"is_dir"').splitlines()
    for i, line in enumerate(lines):
        (folder / f"part-{i:05}.txt").write_text(line + "\n")
    assert sizes(snapshot.import_json(spark, str(folder))) == {"/a}.txt": 1, "/b.txt": 2, "/c.txt": 3}


@pytest.mark.parametrize("cut", [1, 40, 200])
def test_cut_documents_are_refused(spark, tmp_path, cut):
    file = tmp_path / "s.json"
    file.write_text(document(["a.txt", "b.txt"])[:-cut - 1] + "\n")
    with pytest.raises(ValueError):
        snapshot.import_json(spark, str(file))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "file1.txt": "one", "file2.md": "two", "subdir/file3.go": "three", "subdir/file4.txt": "four",
        "subdir2/file5.pdf": "five", ".git/config": "x", "node_modules/pkg.js": "x", "subdir/.hidden": "",
    }.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    (root / "link").symlink_to(root / "subdir")
    return str(root)


def relative(df, root):
    return sorted(p[len(root):] for p in paths(df))


def test_list_files(spark, tree):
    found = listing.list_files(spark, [tree])
    assert relative(found, tree) == sorted(
        ["", "/file1.txt", "/file2.md", "/link", "/subdir", "/subdir/.hidden", "/subdir/file3.go",
         "/subdir/file4.txt", "/subdir2", "/subdir2/file5.pdf"]
    )
    rows = {r.name: r for r in found.collect()}
    assert rows["file3.go"].size == 5 and rows["file3.go"].extension == ".go"
    assert rows["subdir"].is_dir and not rows["link"].is_dir
    assert abs(rows["file3.go"].modified_time - datetime.now(timezone.utc).replace(tzinfo=None)) < timedelta(minutes=10)
    shown = relative(listing.list_files(spark, [tree], skip_dirs=["subdir"], include_hidden=False), tree)
    assert "/subdir" not in shown and "/node_modules/pkg.js" in shown and "/.git" not in shown
    inside = listing.list_files(spark, [tree + "/.git"])
    assert relative(inside, tree) == ["/.git", "/.git/config"]
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, [tree + "/missing"])


def test_list_large_directory_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "ENTRIES_PER_BATCH", 7)
    for i in range(40):
        (tmp_path / f"f{i}").touch()
    assert listing.list_files(spark, [str(tmp_path)]).count() == 41


def test_index_roots(spark, tree):
    roots = [tree, "", "  ", tree + "/missing", tree + "/subdir"]
    with pytest.warns(UserWarning):
        df, failed = listing.index_roots(spark, roots)
    assert failed == [tree + "/missing"]
    assert relative(df, tree) == relative(listing.list_files(spark, [tree]), tree)


def test_list_object_store(spark, tree):
    found = relative(listing.list_object_store(spark, "file:" + tree), "file:" + tree)
    assert "/subdir/file3.go" in found and "/subdir" not in found and "/.git/config" not in found


def test_scan_with_callback(spark, catalog, tmp_path):
    df = catalog(*[f"/{i}" for i in range(20)])
    out = str(tmp_path)
    listing.scan_with_callback(df, lambda row: open(f"{out}/{row.name}", "w").close())
    assert len(list(tmp_path.iterdir())) == 20

    def fail(row):
        raise RuntimeError("stop here")

    with pytest.raises(Exception, match="stop here"):
        listing.scan_with_callback(df, fail)
    doubled = listing.map_files(
        df, lambda batches: (b.assign(size=b["size"] * 2)[["path", "size"]] for b in batches), "path string, size long"
    )
    assert doubled.count() == 20


def write_log(spark, folder, rows):
    changes(spark, *rows).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("merge_every", [1, 2, 1000])
def test_maintain_catalog(spark, catalog, tmp_path, merge_every):
    folder, log, checkpoint = (str(tmp_path / n) for n in ("catalog", "log", "checkpoint"))
    snapshot.save_catalog(catalog(("/a", 1), ("/b", 2)), folder)

    def run():
        stream = spark.readStream.schema(CHANGE_SCHEMA).parquet(log)
        maintain.maintain_catalog(
            stream, folder, checkpoint, timedelta(0), timedelta(seconds=10), merge_every, {"availableNow": True}
        ).awaitTermination()
        return sizes(maintain.current_catalog(spark, folder))

    write_log(spark, log, [(0, "/a", "modify", 5), (2, "/a", "modify", 6), (1, "/x.tmp", "create", 1), (30, "/b", "delete", None)])
    assert run() == {"/a": 6, "/b": 2}
    write_log(spark, log, [(60, "/c", "create", 3), (61, "/c", "modify", 4)])
    assert run() == {"/a": 6}
    write_log(spark, log, [(100, "/z", "create", 9)])
    assert run() == {"/a": 6, "/c": 4}
    assert run() == {"/a": 6, "/c": 4}


def test_maintain_catalog_repeats_a_batch_safely(spark, catalog, tmp_path):
    folder, log = str(tmp_path / "catalog"), str(tmp_path / "log")
    write_log(spark, log, [(0, "/a", "create", 5), (50, "/b", "create", 6)])
    for attempt in range(2):
        stream = spark.readStream.schema(CHANGE_SCHEMA).parquet(log)
        maintain.maintain_catalog(
            stream, folder, str(tmp_path / f"checkpoint{attempt}"), timedelta(0), timedelta(seconds=10), trigger={"availableNow": True}
        ).awaitTermination()
        assert sizes(maintain.current_catalog(spark, folder)) == {"/a": 5}


def test_late_changes_are_not_lost(spark, catalog, tmp_path):
    folder, log, checkpoint = (str(tmp_path / n) for n in ("catalog", "log", "checkpoint"))
    snapshot.save_catalog(catalog(("/base", 1), ("/gone", 2)), folder)

    def run():
        stream = spark.readStream.schema(CHANGE_SCHEMA).parquet(log)
        maintain.maintain_catalog(
            stream, folder, checkpoint, timedelta(0), timedelta(seconds=5), trigger={"availableNow": True}
        ).awaitTermination()
        return sizes(maintain.current_catalog(spark, folder))

    write_log(spark, log, [(0, "/a", "create", 1), (100, "/b", "create", 2), (110, "/gone", "delete", None)])
    assert run() == {"/base": 1, "/gone": 2, "/a": 1, "/b": 2}
    # Late: a new path, a change older than the one applied, and one between two others.
    write_log(spark, log, [(50, "/late", "create", 3), (40, "/b", "delete", None), (200, "/b", "modify", 5)])
    assert run() == {"/base": 1, "/late": 3, "/a": 1, "/b": 2}
    write_log(spark, log, [(150, "/b", "modify", 4), (60, "/gone", "modify", 9)])
    assert run() == {"/base": 1, "/late": 3, "/a": 1, "/b": 4}
    number = snapshot.read_manifest(spark, folder).number
    assert run() == {"/base": 1, "/late": 3, "/a": 1, "/b": 4}
    assert snapshot.read_manifest(spark, folder).number == number  # nothing new, nothing written
    maintain.drain(spark, folder)
    assert sizes(maintain.current_catalog(spark, folder)) == {"/base": 1, "/late": 3, "/a": 1, "/b": 5}
    maintain.compact(spark, folder)
    write_log(spark, log, [(300, "/late", "delete", None), (400, "/c", "create", 1)])
    assert run() == {"/base": 1, "/a": 1, "/b": 5}


def test_repeated_paths_are_refused(spark, catalog, tmp_path):
    twice = catalog(*[f"/{i}" for i in range(30)]).unionByName(catalog("/7"))
    with pytest.raises(ValueError, match="/7"):
        snapshot.save_catalog(twice, str(tmp_path / "c"), partitions=3)
    assert snapshot.read_manifest(spark, str(tmp_path / "c")) is None


def test_stream_settles_a_subset_of_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.uniform(0, 200), f"/p{rng.randint(0, 9)}", "modify", i) for i in range(200)]
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    write_log(spark, log, rows)
    delay = timedelta(seconds=3)
    stream = spark.readStream.schema(CHANGE_SCHEMA).parquet(log)
    settled = d.debounce_stream(stream, timedelta(0), delay)
    settled.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start().awaitTermination()
    columns = ["path", "ts", "seq", "settled_at"]
    streamed = set(map(tuple, spark.read.schema(settled.schema).parquet(out).select(*columns).collect()))
    batch = set(map(tuple, d.debounce(changes(spark, *rows), delay).select(*columns).collect()))
    assert streamed <= batch and len(streamed) >= len(batch) - 10


def test_deliver_changes(spark, tmp_path):
    log = str(tmp_path / "log")
    write_log(spark, log, [(0, "/a", "create", 5), (1, "/b", "delete", None), (2, "/c", "modify", None), (90, "/z", "create", 1)])
    got = {"upsert": [], "delete": []}
    stream = spark.readStream.schema(CHANGE_SCHEMA).parquet(log)
    maintain.deliver_changes(
        d.debounce_stream(stream, timedelta(0), timedelta(seconds=5)),
        lambda df, _: got["upsert"].extend(paths(df)),
        lambda df, _: got["delete"].extend(paths(df)),
        str(tmp_path / "cp"),
        {"availableNow": True},
    ).awaitTermination()
    assert got == {"upsert": ["/a"], "delete": ["/b"]}


def test_late_changes_are_delivered_as_differences(spark, catalog, tmp_path):
    folder, log, checkpoint = (str(tmp_path / n) for n in ("catalog", "log", "checkpoint"))
    snapshot.save_catalog(catalog(("/base", 1), ("/gone", 2), ("/same", 3)), folder)
    got = []
    sinks = {
        "on_upsert": lambda df, number: got.append((number, sizes(df))),
        "on_delete": lambda df, number: got.append((number, sorted(paths(df)))),
    }

    def run():
        got.clear()
        stream = spark.readStream.schema(CHANGE_SCHEMA).parquet(log)
        maintain.maintain_catalog(
            stream, folder, checkpoint, timedelta(0), timedelta(seconds=5), trigger={"availableNow": True}, **sinks
        ).awaitTermination()
        return list(got)

    first = snapshot.read_manifest(spark, folder).number + 1
    write_log(spark, log, [
        (0, "/a", "create", 1), (1, "/same", "modify", 3), (2, "/none", "delete", None),
        (90, "/gone", "delete", None), (100, "/b", "create", 2),
    ])
    # The times for delay and lateness are recorded by one version more.
    assert run() == [(first + 1, {"/a": 1}), (first + 1, ["/gone"])]
    # Late, newer than what went out of the path; late, older; late and joining a settled change to one that waits.
    write_log(spark, log, [(50, "/a", "modify", 7), (40, "/gone", "modify", 9), (94, "/gone", "create", 4), (104, "/z", "create", 1)])
    assert run() == [(first + 2, {"/a": 7, "/gone": 4}), (first + 2, [])]
    write_log(spark, log, [(60, "/a", "delete", None)])
    assert run() == [(first + 3, {}), (first + 3, ["/a"])]
    got.clear()
    maintain.drain(spark, folder, **sinks)
    assert got == [(first + 4, {"/b": 2, "/z": 1}), (first + 4, [])]
    assert sizes(maintain.current_catalog(spark, folder)) == {"/base": 1, "/same": 3, "/gone": 4, "/b": 2, "/z": 1}


def test_debounce_reads_its_changes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def path_of(number):
        seen.add(1)
        return f"/p{number % 5}"

    times = F.timestamp_seconds(F.col("id") * 3600)
    changes = spark.range(100).select(
        path_of("id").alias("path"), times.alias("ts"), F.col("id").alias("seq"), F.lit("modify").alias("op")
    )
    found = d.debounce(changes, timedelta(hours=1)).collect()
    assert len(found) == 100 and seen.value == 100
