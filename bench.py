"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The catalog and the other inputs are saved once, as a user would keep them. Each
number is the best of three runs after one warm-up; results go to Spark's ``noop`` sink, so all rows
are computed.
"""

from __future__ import annotations

import json
import os
import time
from datetime import timedelta

from pyspark.sql import SparkSession

from shelfmark.functions import predicates as p
from shelfmark.operators import merge, rank, search as s, stats
from shelfmark.operators.batch_search import search_many
from shelfmark.operators.fuzzy_join import fuzzy_join
from shelfmark.operators.query_table import parse_queries
from shelfmark.plans import registry, workload
from shelfmark.plans.storage import reliable, scratch_path
from shelfmark.sources import snapshot
from shelfmark.streaming.debounce import debounce

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = 3


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def workloads(spark: SparkSession) -> dict:
    files = workload.files(spark, SF_DIR)
    folder = scratch_path(spark, "bench-catalog")
    snapshot.save_catalog(files, folder, partitions=CPUS)
    saved = snapshot.load_catalog(spark, folder)
    unsorted = reliable(files)
    queries = parse_queries(workload.query_log(spark, SF_DIR))
    incoming = reliable(registry._incoming_rows(spark, SF_DIR))
    home = reliable(registry._home(spark, SF_DIR))
    changes = reliable(workload.changes(spark, SF_DIR))
    patterns = reliable(queries.filter("error IS NULL AND pattern <> ''").select("pattern"))

    def flagship():
        found = s.search_name(saved, "config", ordered=False)
        found = p.apply_filters(found, p.has_any_extension(".go"), p.min_size(1024))
        return rank.top_k(rank.with_score(found, "config"), 50)

    def save():
        snapshot.save_catalog(files, scratch_path(spark, "bench-save"), partitions=CPUS)

    return {
        "save_catalog": save,
        "load_catalog": lambda: drain(snapshot.load_catalog(spark, folder)),
        "top_k": lambda: drain(flagship()),
        "prefix_search": lambda: drain(s.search_prefix(saved, "/urg/cust1/")),
        "prefix_search_unsorted": lambda: drain(s.search_prefix(unsorted, "/urg/cust1/")),
        "get_by_path": lambda: drain(s.get_by_path(saved, "/hig/cust0/o10206/report.tmp")),
        "name_search": lambda: drain(s.search_name(saved, "config")),
        "regex_search": lambda: drain(s.search_regex(saved, r"^[rR]e.*\.(txt|md)$")),
        "fuzzy_search": lambda: drain(s.search_fuzzy(saved, "config.go")),
        "search_text": lambda: drain(s.search_text(saved, "config ext:.go,md size:>1KB", 50)),
        "rank_all": lambda: drain(rank.rank(saved, "readme")),
        "catalog_stats": lambda: drain(stats.catalog_stats(saved)),
        "stats_by_extension": lambda: drain(stats.stats_by_extension(saved)),
        "prefix_counts": lambda: drain(stats.prefix_counts(saved, registry._prefixes(spark, SF_DIR))),
        "parse_queries": lambda: drain(queries),
        "search_many_1": lambda: drain(search_many(saved, queries.filter("query_id = 7"), 50)),
        "search_many_100": lambda: drain(search_many(saved, queries.filter("query_id < 100"), 50)),
        "search_many": lambda: drain(search_many(saved, queries, 50)),
        "fuzzy_join": lambda: drain(fuzzy_join(saved, patterns, 2)),
        "upsert": lambda: drain(merge.upsert(saved, incoming, ["seq"])),
        "apply_changes": lambda: drain(merge.apply_changes(home, changes)),
        "debounce": lambda: drain(debounce(changes, timedelta(hours=1))),
    }


def main() -> None:
    spark = session()
    seconds = {}
    for name, run in workloads(spark).items():
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    rows = workload.files(spark, SF_DIR).count()
    print(
        json.dumps(
            {
                "metric": "sum of best warm run per query",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "catalog_rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
