import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfmark.plans import registry

SF = "/root/testdata/sf0.001"


def brute_distance(a, b):
    """Over bytes, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(above + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edit_distance_reads_whole_pages(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").slice(0, 25).to_pylist()
    found = {r.page_id: r.b for r in registry.QUERIES["prj5_edit_distance_html"](spark, SF).collect()}
    assert any(len(p["html"] or "") > 99 for p in pages)
    for p in pages:
        html = p["html"] or ""
        title = re.search("<title>([^<]*)", html)
        title = title[1] if title else ""
        assert found[p["page_id"]] == brute_distance(title.encode(), html.encode())


@pytest.mark.parametrize("name", ["src1_list_files_per_directory", "src9_index_roots_per_directory"])
def test_listed_files_are_those_spark_sees(spark, name):
    folder = registry._tree(spark, SF)
    data = spark.read.parquet(folder).select(
        "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
    ).distinct()
    below = F.regexp_extract("file_path", "(/block=[^/]*/nation=[^/]*)/[^/]*$", 1)
    wanted = data.groupBy(below.alias("path")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"),
        F.max(F.unix_millis("file_modification_time")).alias("newest"),
    )
    files = registry.QUERIES[name](spark, SF, folder)
    # Hadoop keeps milliseconds; the listing has the file system's own times.
    newest = F.unix_millis(F.col("newest").cast("timestamp")).alias("newest")
    found = files.filter("extension = '.parquet'").select("path", "files", "bytes", newest)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in wanted.collect()}
    assert registry.QUERIES[name](spark, SF).agg(F.sum("files")).first()[0] >= wanted.count() > 1
    assert files.filter("path = '' AND extension <> '.parquet'").count() > 0
