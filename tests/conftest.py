import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def catalog(spark):
    """Catalogs from ``(path, size, is_dir, mtime)`` tuples; the last three may be left out."""
    from shelfmark.schema import catalog_from_manifest

    def make(*rows):
        full = []
        for row in rows:
            row = (row,) if isinstance(row, str) else row
            path, size, is_dir, mtime = (*row, 0, False, datetime(2024, 1, 1))[:1] + (
                row[1] if len(row) > 1 else 0,
                row[2] if len(row) > 2 else False,
                row[3] if len(row) > 3 else datetime(2024, 1, 1),
            )
            full.append((path, size, mtime, is_dir))
        schema = "path string, size long, modified_time timestamp, is_dir boolean"
        return catalog_from_manifest(spark.createDataFrame(full, schema))

    return make


def names(df):
    return [row["name"] for row in df.collect()]


def paths(df):
    return [row["path"] for row in df.collect()]
