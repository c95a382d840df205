"""Every operator over the test tables, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions import naming, predicates as p, scoring, text
from shelfmark.operators import merge, query_table, rank, search as s, stats
from shelfmark.operators.batch_search import search_many
from shelfmark.operators.fuzzy_join import fuzzy_join
from shelfmark.plans import workload
from shelfmark.plans.sizing import spread
from shelfmark.plans.storage import scratch_path
from shelfmark.sources import change_log, listing, snapshot
from shelfmark.schema import CATALOG_COLUMNS, catalog_from_manifest
from shelfmark.streaming import debounce as d, maintain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NOW = datetime(2001, 8, 2)
AS_OF = datetime(2024, 1, 25, 12)
DELAY = timedelta(hours=48)
LATENESS = timedelta(hours=1)
ROW = ", ".join(CATALOG_COLUMNS)


def with_views(body: str) -> str:
    """The SQL with the derived tables it mentions in front."""
    views = {
        "files": workload.FILES_SQL,
        "changes": workload.CHANGES_SQL,
        "query_log": workload.QUERY_LOG_SQL,
    }
    views.update(DERIVED_SQL)
    used: list[str] = []

    def need(sql: str) -> None:
        for name in views:
            if name not in used and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                need(views[name])
                if name not in used:
                    used.append(name)

    need(body)
    if not used:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in used) + "\n" + body


DERIVED_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the session and the table folder under a name."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return function

    return register


def on_files(name: str, sql: str | None = None):
    """The same for a function of the ``files`` catalog."""

    def register(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(workload.files(spark, sf_dir))

        query(name, sql)(run)
        return function

    return register


def _now():
    return F.to_timestamp_ntz(F.lit(str(NOW)))


def _ntz(value: str):
    return F.to_timestamp_ntz(F.lit(value))


# Projections

@on_files(
    "prj1_human_size",
    """
SELECT path, CASE WHEN size < 1024 THEN concat(CAST(size AS VARCHAR), ' B')
  WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0)
  WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0)
  ELSE printf('%.1f GB', size / 1073741824.0) END AS human FROM files
""",
)
def _(files):
    return files.select("path", text.human_size(F.col("size")).alias("human"))


@on_files("prj2_format_mtime", "SELECT path, strftime(modified_time, '%Y-%m-%d %H:%M:%S') AS mtime FROM files")
def _(files):
    return files.select("path", text.format_mtime(F.col("modified_time")).alias("mtime"))


@on_files(
    "prj3_describe_file",
    """
SELECT concat(CASE WHEN is_dir THEN 'dir' ELSE 'file' END, ': ', path, ' (',
  CASE WHEN size < 1024 THEN concat(CAST(size AS VARCHAR), ' B')
  WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0)
  WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0)
  ELSE printf('%.1f GB', size / 1073741824.0) END,
  ', ', strftime(modified_time, '%Y-%m-%d %H:%M:%S'), ')') AS line FROM files
""",
)
def _(files):
    columns = [F.col(c) for c in ("path", "size", "modified_time", "is_dir")]
    return files.select(text.describe_file(*columns).alias("line"))


@on_files(
    "prj4_normalize_extension",
    """
SELECT path, CASE WHEN bare = '' OR starts_with(bare, '.') THEN bare ELSE concat('.', bare) END AS ext
FROM (SELECT path, replace(extension, '.', CASE WHEN is_dir THEN '.' ELSE '' END) AS bare FROM files)
""",
)
def _(files):
    bare = F.when(F.col("is_dir"), F.col("extension")).otherwise(
        F.replace("extension", F.lit("."), F.lit(""))
    )
    return files.select("path", naming.normalize_extension(bare).alias("ext"))


@query(
    "prj5_edit_distance_html",
    """
SELECT page_id, CAST(levenshtein(title, url) AS INT) AS a, CAST(levenshtein(title, coalesce(html, '')) AS INT) AS b
FROM (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)
""",
)
def _(spark, sf_dir):
    """Whole titles against whole addresses and whole pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return pages.select(
        "page_id",
        text.edit_distance(title, F.col("url")).alias("a"),
        text.edit_distance(title, F.coalesce("html", F.lit(""))).alias("b"),
    )


@query(
    "prj6_parse_size",
    """
SELECT query_id, coalesce(CAST(CASE WHEN regexp_full_match(t, '[0-9]+') THEN TRY_CAST(t AS BIGINT)
  WHEN regexp_full_match(t, '([0-9]+[.]?[0-9]*|[.][0-9]+)[KMGT]?B') THEN
    TRY_CAST(trunc(TRY_CAST(regexp_replace(t, '[KMGT]?B$', '') AS DOUBLE) *
    CASE WHEN t LIKE '%TB' THEN 1099511627776 WHEN t LIKE '%GB' THEN 1073741824
         WHEN t LIKE '%MB' THEN 1048576 WHEN t LIKE '%KB' THEN 1024 ELSE 1 END) AS BIGINT) END AS VARCHAR), 'error') AS bytes
FROM (SELECT query_id, upper(CASE query_id % 6 WHEN 0 THEN concat(query_id, 'kb') WHEN 1 THEN concat(query_id, '.5MB')
  WHEN 2 THEN CAST(query_id AS VARCHAR) WHEN 3 THEN concat('-', query_id) WHEN 4 THEN concat(query_id, 'B')
  ELSE concat('x', query_id) END) AS t FROM query_log)
""",
)
def _(spark, sf_dir):
    log = workload.query_log(spark, sf_dir)
    sizes = F.expr(
        "CASE query_id % 6 WHEN 0 THEN concat(query_id, 'kb') WHEN 1 THEN concat(query_id, '.5MB') "
        "WHEN 2 THEN CAST(query_id AS STRING) WHEN 3 THEN concat('-', query_id) "
        "WHEN 4 THEN concat(query_id, 'B') ELSE concat('x', query_id) END"
    )
    parsed = text.parse_size(sizes).cast("string")
    return log.select("query_id", F.coalesce(parsed, F.lit("error")).alias("bytes"))


@on_files(
    "prj7_wildcard_to_regex",
    """
SELECT path, regexp_matches(name, concat('^',
  replace(replace(replace(concat('*', extension), '.', '\\.'), '*', '.*'), '?', '.'), '$')) AS hit,
  concat('^', replace(replace(replace(name, '.', '\\.'), '_', '?'), '?', '.'), '\\z') AS regex FROM files
""".replace("\\\\", "\\"),
)
def _(files):
    own = text.wildcard_to_regex(F.concat(F.lit("*"), F.col("extension")))
    return files.select(
        "path",
        F.rlike("name", own).alias("hit"),
        text.wildcard_to_regex(F.translate("name", "_", "?")).alias("regex"),
    )


@query(
    "prj8_event_type_name",
    """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Create' WHEN 1 THEN 'Modify' WHEN 2 THEN 'Delete'
  WHEN 3 THEN 'Rename' ELSE 'Unknown' END AS name FROM events
""",
)
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = (F.col("event_id") % 6).cast("int")
    return events.select("event_id", text.event_type_name(code).alias("name"))


@query(
    "prj9_query_type_name",
    """
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'prefix' WHEN 1 THEN 'exact' WHEN 2 THEN 'substring'
  WHEN 3 THEN 'wildcard' WHEN 4 THEN 'regex' WHEN 5 THEN 'fuzzy' ELSE 'unknown' END AS name FROM customer
""",
)
def _(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    code = (F.col("c_custkey") % 8).cast("int")
    return customer.select("c_custkey", text.query_type_name(code).alias("name"))


# Predicates: a Column and the SQL condition that selects the same rows

def _listed(extensions: list[str]) -> str:
    return "NOT is_dir AND extension IN (" + ", ".join(f"'{e}'" for e in extensions) + ")"


NOW_SQL = f"TIMESTAMP '{NOW}'"
PREDICATES = {
    "flt1_size_between": (lambda: p.size_between(1000, 100_000), "NOT is_dir AND size BETWEEN 1000 AND 100000"),
    "flt1_size_unbounded": (lambda: p.size_between(0, -1), "NOT is_dir"),
    "flt2_min_size": (lambda: p.min_size(1024), "NOT is_dir AND size >= 1024"),
    "flt3_max_size": (lambda: p.max_size(1024), "NOT is_dir AND size <= 1024"),
    "flt4_non_empty": (lambda: p.non_empty(), "NOT is_dir AND size > 0"),
    "flt5_large": (lambda: p.large(), "NOT is_dir AND size >= 104857600"),
    "flt6_modified_after": (lambda: p.modified_after(_ntz("2000-01-01")), "modified_time > TIMESTAMP '2000-01-01'"),
    "flt7_modified_before": (lambda: p.modified_before(_ntz("1996-01-01")), "modified_time < TIMESTAMP '1996-01-01'"),
    "flt8_modified_between": (
        lambda: p.modified_between(_ntz("1996-01-01"), _ntz("1996-02-01")),
        "modified_time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-02-01'",
    ),
    "flt9_modified_within_days": (lambda: p.modified_within_days(90, _now()), f"modified_time > {NOW_SQL} - INTERVAL 90 DAY"),
    "flt10_modified_within_hours": (lambda: p.modified_within_hours(72, _now()), f"modified_time > {NOW_SQL} - INTERVAL 72 HOUR"),
    "flt11_older_than_days": (lambda: p.older_than_days(365, _now()), f"modified_time < {NOW_SQL} - INTERVAL 365 DAY"),
    "flt12_modified_today": (
        lambda: p.modified_today(_ntz("2001-07-30 15:00:00")),
        "modified_time > TIMESTAMP '2001-07-30 00:00:00'",
    ),
    "flt13_has_any_extension": (lambda: p.has_any_extension("go", ".md", ""), _listed([".go", ".md", ""])),
    "flt14_no_extension": (lambda: p.no_extension(), "NOT is_dir AND extension = ''"),
    "flt15_has_extension": (lambda: p.has_extension(), "NOT is_dir AND extension <> ''"),
    "flt16_text_files": (lambda: p.text_files(), _listed(p.TEXT_EXTENSIONS)),
    "flt17_code_files": (lambda: p.code_files(), _listed(p.CODE_EXTENSIONS)),
    "flt18_image_files": (lambda: p.image_files(), _listed(p.IMAGE_EXTENSIONS)),
    "flt19_video_files": (lambda: p.video_files(), _listed(p.VIDEO_EXTENSIONS)),
    "flt20_audio_files": (lambda: p.audio_files(), _listed(p.AUDIO_EXTENSIONS)),
    "flt21_document_files": (lambda: p.document_files(), _listed(p.DOCUMENT_EXTENSIONS)),
    "flt22_archive_files": (lambda: p.archive_files(), _listed(p.ARCHIVE_EXTENSIONS)),
    "flt23_directories": (lambda: p.directories(), "is_dir"),
    "flt24_files_only": (lambda: p.files_only(), "NOT is_dir"),
    "flt25_hidden": (lambda: p.hidden(), "starts_with(name, '.')"),
    "flt26_visible": (lambda: p.visible(), "name <> '' AND NOT starts_with(name, '.')"),
    "flt27_recent_large": (
        lambda: p.recent_large(1 << 20, 365, _now()),
        f"NOT is_dir AND size >= 1048576 AND modified_time > {NOW_SQL} - INTERVAL 365 DAY",
    ),
    "flt28_old_large": (
        lambda: p.old_large(1 << 20, 365, _now()),
        f"NOT is_dir AND size >= 1048576 AND modified_time < {NOW_SQL} - INTERVAL 365 DAY",
    ),
    "flt29_all_of": (lambda: p.all_of(p.code_files(), p.min_size(2048)), _listed(p.CODE_EXTENSIONS) + " AND size >= 2048"),
    "flt29_all_of_nothing": (lambda: p.all_of(), "true"),
    "flt30_any_of": (lambda: p.any_of(p.hidden(), p.directories()), "starts_with(name, '.') OR is_dir"),
    "flt30_any_of_nothing": (lambda: p.any_of(), "true"),
    "flt31_not": (lambda: p.not_(p.size_between(1000, 0)), "NOT (NOT is_dir AND size >= 1000)"),
    "flt33_matches_extension": (lambda: p.matches_extension("go"), "extension = '.go'"),
    "flt33_matches_any_extension": (lambda: p.matches_extension(""), "true"),
    "flt34_should_ignore": (
        lambda: p.should_ignore(),
        "starts_with(name, '.') OR extension IN ('.tmp', '.swp', '.bak') OR ends_with(name, '~') "
        "OR name IN ('Thumbs.db', 'desktop.ini', '.DS_Store')",
    ),
    "flt35_in_skipped_dir": (
        lambda: p.in_skipped_dir(skip=["hig", "cust12", ".env"]),
        "split_part(path, '/', 2) = 'hig' OR split_part(path, '/', 3) = 'cust12' OR (is_dir AND name = '.env')",
    ),
}


def _register_predicate(name: str, make, condition: str) -> None:
    @on_files(name, f"SELECT path, size, modified_time FROM files WHERE {condition}")
    def run(files):
        return files.filter(make()).select("path", "size", "modified_time")


for _name, (_make, _condition) in PREDICATES.items():
    _register_predicate(_name, _make, _condition)


@on_files(
    "flt32_apply_filters",
    f"SELECT {ROW} FROM files WHERE NOT is_dir AND size >= 1024 AND NOT starts_with(name, '.') AND extension = '.go'",
)
def _(files):
    return p.apply_filters(files, p.min_size(1024), p.visible(), p.has_any_extension(".go"))


# Searches

SEARCHES = {
    "sea1_search_prefix": (lambda f: s.search_prefix(f, "/urg/cust1"), "starts_with(path, '/urg/cust1')"),
    "sea1_search_prefix_all": (lambda f: s.search_prefix(f, ""), "true"),
    "sea2_search_name": (lambda f: s.search_name(f, "CONFIG"), "contains(lower(name), 'config')"),
    "sea2_search_name_nothing": (lambda f: s.search_name(f, ""), "false"),
    "sea3_search_extension": (lambda f: s.search_extension(f, "md"), "extension = '.md'"),
    "sea3_search_extension_nothing": (lambda f: s.search_extension(f, ""), "false"),
    "sea4_files_by_extension": (lambda f: s.files_by_extension(f, "go"), "NOT is_dir AND extension = '.go'"),
    "sea4_files_by_extension_all": (lambda f: s.files_by_extension(f, ""), "NOT is_dir"),
    "sea5_search_extensions": (lambda f: s.search_extensions(f, [".jpg", "jpg", ".pdf"]), "extension IN ('.jpg', '.pdf')"),
    "sea5_search_extensions_nothing": (lambda f: s.search_extensions(f, []), "false"),
    "sea6_search_exact": (lambda f: s.search_exact(f, "readme.TXT"), "lower(name) = 'readme.txt'"),
    "sea6_search_exact_case": (lambda f: s.search_exact(f, "README", True), "name = 'README'"),
    "sea7_search_substring": (lambda f: s.search_substring(f, "Config"), "contains(lower(name), 'config')"),
    "sea7_search_substring_case": (lambda f: s.search_substring(f, "Config", True), "contains(name, 'Config')"),
    "sea8_search_wildcard": (lambda f: s.search_wildcard(f, "READ??*.t*"), r"lower(name) LIKE 'read__%.t%' ESCAPE '\'"),
    "sea8_search_wildcard_case": (lambda f: s.search_wildcard(f, "test_*.md", True), r"name LIKE 'test\_%.md' ESCAPE '\'"),
    "sea9_search_regex": (lambda f: s.search_regex(f, r"^[rR]e.*\.(txt|md)$"), r"regexp_matches(name, '^[rR]e.*\.(txt|md)$')"),
    "sea10_search_fuzzy": (lambda f: s.search_fuzzy(f, "Config.Go"), "levenshtein(lower(name), 'config.go') <= 2"),
    "sea10_search_fuzzy_clamped": (lambda f: s.search_fuzzy(f, "README", 9, True), "levenshtein(name, 'README') <= 5"),
    "sea10_search_fuzzy_stem": (
        lambda f: s.search_fuzzy(f, "config", 1, on="stem"),
        r"levenshtein(lower(regexp_replace(name, '\.[^.]*$', '')), 'config') <= 1",
    ),
    "sea11_get_by_path": (lambda f: s.get_by_path(f, "/hig/cust0/o10206/report.tmp"), "path = '/hig/cust0/o10206/report.tmp'"),
    "sea13_all_files": (s.all_files, "true"),
}


def _register_search(name: str, function, condition: str) -> None:
    on_files(name, f"SELECT {ROW} FROM files WHERE {condition}")(function)


for _name, (_function, _condition) in SEARCHES.items():
    _register_search(_name, _function, _condition)


@on_files("sea12_contains_path", "SELECT count(*) > 0 AS found FROM files WHERE path = '/hig/cust0/o10206/report.tmp'")
def _(files):
    return s.contains_path(files, "/hig/cust0/o10206/report.tmp")


@query(
    "sea12_contains_paths",
    """
SELECT path FROM (SELECT concat('/', lower(substr(o_orderpriority, 3, 3)), '/cust', o_custkey % 97,
  '/o', o_orderkey, '/config.go') AS path FROM orders) SEMI JOIN files USING (path)
""",
)
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    asked = orders.select(
        F.expr(
            "concat('/', lower(substr(o_orderpriority, 3, 3)), '/cust', o_custkey % 97, "
            "'/o', o_orderkey, '/config.go')"
        ).alias("path")
    )
    return s.contains_paths(workload.files(spark, sf_dir), asked)


SCORE_SQL = """(CASE WHEN lower(name) = '{q}' THEN 100 WHEN starts_with(lower(name), '{q}') THEN 50
  WHEN contains(lower(name), '{q}') THEN 25 ELSE 0 END
  + CASE WHEN size < 1024 THEN 10 WHEN size < 1048576 THEN 5 ELSE 0 END)"""


@on_files(
    "sea14_search",
    f"""
SELECT {ROW}, CAST({SCORE_SQL.format(q='config')} AS INT) AS score FROM files
WHERE contains(lower(name), 'config') AND {_listed(['.go', '.md'])} AND size >= 1024 AND size <= 50000000
""",
)
def _(files):
    spec = s.SearchSpec("substring", "Config", False, [".go", "md"], 1024, 50_000_000)
    return s.search(files, spec)


@on_files(
    "sea14_search_text",
    f"""
SELECT {ROW}, score, rank FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM (
    SELECT *, CAST({SCORE_SQL.format(q='config.go')} AS INT) AS score FROM files
    WHERE levenshtein(lower(name), 'config.go') <= 2 AND NOT is_dir AND size >= 1025))
WHERE rank <= 50
""",
)
def _(files):
    found = s.search_text(files, "fuzzy:config.go size:>1KB", 50)
    return _numbered(found)


def _numbered(top: DataFrame) -> DataFrame:
    """Positions of an already limited, ordered result."""
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(*rank.by_score())).cast("long"))


@on_files(
    "sea14_search_filters_only",
    f"SELECT {ROW}, CAST(0 AS INT) AS score FROM files WHERE NOT is_dir AND size >= 10485761 AND extension = '.jpg'",
)
def _(files):
    return s.search_text(files, "size:>10MB ext:jpg")


# The query grammar in SQL; searches over the whole log build on it.
DERIVED_SQL["tokens"] = r"""
SELECT query_id, raw, toks, len(toks) > 0 AND regexp_matches(toks[1], '^(regex|fuzzy|exact):') AS typed
FROM (SELECT query_id, raw, list_filter(string_split_regex(raw, '\s+'), lambda x: x <> '') AS toks FROM query_log)
"""
DERIVED_SQL["pieces"] = r"""
SELECT query_id, raw, len(toks) AS n,
  array_to_string(CASE WHEN typed THEN list_concat([toks[1]], list_filter(toks[2:], lambda x: NOT contains(x, ':')))
       ELSE list_filter(toks, lambda x: NOT contains(x, ':')) END, ' ') AS body,
  list_filter(CASE WHEN typed THEN toks[2:] ELSE toks END, lambda x: contains(x, ':')) AS opts
FROM tokens
"""
DERIVED_SQL["options"] = r"""
SELECT *, regexp_extract(body, '^(regex|fuzzy|exact):', 1) AS word,
  regexp_replace(body, '^(regex|fuzzy|exact):', '') AS pattern,
  list_transform(list_filter(opts, lambda x: starts_with(lower(x), 'size:')), lambda x: substr(x, 6)) AS sizes,
  list_transform(list_filter(opts, lambda x: regexp_matches(lower(x), '^ext(ension)?:')),
                 lambda x: regexp_replace(x, '^[^:]*:', '')) AS exts,
  list_transform(list_filter(opts, lambda x: starts_with(lower(x), 'case:')), lambda x: lower(substr(x, 6))) AS cases,
  list_filter(list_transform(list_filter(opts, lambda x: starts_with(lower(x), 'fuzzy:')),
    lambda x: TRY_CAST(regexp_extract(x, ':([+-]?[0-9]+)', 1) AS INT)), lambda x: x IS NOT NULL) AS dists
FROM pieces
"""
_BYTES = r"""(CASE WHEN regexp_full_match({v}, '[0-9]+') THEN TRY_CAST({v} AS BIGINT)
  WHEN regexp_full_match({v}, '([0-9]+[.]?[0-9]*|[.][0-9]+)[KMGT]?B') THEN
  CAST(trunc(CAST(regexp_replace({v}, '[KMGT]?B$', '') AS DOUBLE) *
    CASE WHEN {v} LIKE '%TB' THEN 1099511627776 WHEN {v} LIKE '%GB' THEN 1073741824
         WHEN {v} LIKE '%MB' THEN 1048576 WHEN {v} LIKE '%KB' THEN 1024 ELSE 1 END) AS BIGINT) END)"""
_BOUND = r"upper(regexp_extract({s}, '^(>=|<=|>|<)(.*)$', 2))"
DERIVED_SQL["parsed"] = rf"""
SELECT query_id, raw, n, pattern, type, cs, extensions, bad_size,
  {_BYTES.format(v="lo_text")} + CASE WHEN lo_strict THEN 1 ELSE 0 END AS min_size,
  {_BYTES.format(v="hi_text")} - CASE WHEN hi_strict THEN 1 ELSE 0 END AS max_size,
  CASE WHEN type = 'fuzzy' THEN greatest(1, least(5, dist)) ELSE dist END AS fuzzy_distance
FROM (SELECT *,
  CASE WHEN word <> '' THEN word WHEN regexp_matches(body, '^[/\\]') THEN 'prefix'
       WHEN regexp_matches(body, '[*?]') THEN 'wildcard' ELSE 'substring' END AS type,
  coalesce(cases[-1] = 'true', false) AS cs,
  list_transform(list_filter(string_split(coalesce(exts[-1], ''), ','), lambda x: x <> ''),
    lambda x: CASE WHEN starts_with(x, '.') THEN x ELSE concat('.', x) END) AS extensions,
  coalesce(dists[-1], 2) AS dist,
  list_filter(sizes, lambda x: {_BYTES.format(v=_BOUND.format(s="x"))} IS NULL)[1] AS bad_size,
  {_BOUND.format(s="list_filter(sizes, lambda x: starts_with(x, '>'))[-1]")} AS lo_text,
  {_BOUND.format(s="list_filter(sizes, lambda x: starts_with(x, '<'))[-1]")} AS hi_text,
  NOT starts_with(list_filter(sizes, lambda x: starts_with(x, '>'))[-1], '>=') AS lo_strict,
  NOT starts_with(list_filter(sizes, lambda x: starts_with(x, '<'))[-1], '<=') AS hi_strict
  FROM options)
"""
DERIVED_SQL["read_log"] = """
SELECT query_id, raw, type, pattern, cs, extensions, min_size, max_size, CAST(fuzzy_distance AS INT) AS fuzzy_distance,
  CASE WHEN n = 0 THEN 'nothing is asked for'
       WHEN bad_size IS NOT NULL THEN concat('not a size: ', bad_size)
       WHEN trim(pattern) = '' AND (type <> 'substring' OR (len(extensions) = 0 AND min_size IS NULL AND max_size IS NULL))
         THEN 'there is no pattern' END AS error
FROM parsed
"""
_SHOWN = """query_id, raw, type, pattern, cs AS case_sensitive, array_to_string(extensions, ',') AS extensions,
  coalesce(CAST(min_size AS VARCHAR), 'none') AS min_size, coalesce(CAST(max_size AS VARCHAR), 'none') AS max_size,
  fuzzy_distance"""


def _shown(queries: DataFrame) -> DataFrame:
    bound = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c)
    return queries.select(
        "query_id",
        "raw",
        "type",
        "pattern",
        "case_sensitive",
        F.array_join("extensions", ",").alias("extensions"),
        bound("min_size"),
        bound("max_size"),
        "fuzzy_distance",
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query("sea15_parse_queries", f"SELECT {_SHOWN}, coalesce(error, '') AS error FROM read_log")
def _(spark, sf_dir):
    return _shown(query_table.parse_queries(workload.query_log(spark, sf_dir)))


@query(
    "sea16_validate_queries",
    f"""
SELECT {_SHOWN}, coalesce(error, CASE WHEN min_size > 0 AND max_size > 0 AND min_size > max_size THEN
  concat('least size ', min_size, ' is above largest size ', max_size) END, '') AS error FROM read_log
""",
)
def _(spark, sf_dir):
    parsed = query_table.parse_queries(workload.query_log(spark, sf_dir))
    return _shown(query_table.validate_queries(parsed))


def _many(spark, sf_dir, k, **options):
    parsed = query_table.parse_queries(workload.query_log(spark, sf_dir))
    return search_many(workload.files(spark, sf_dir), parsed, k, **options)


DERIVED_SQL["asked"] = """
SELECT DISTINCT type, pattern, cs, extensions, min_size, max_size, fuzzy_distance FROM read_log WHERE error IS NULL
"""
DERIVED_SQL["names"] = "SELECT DISTINCT name FROM files"
DERIVED_SQL["hits"] = r"""
SELECT type, pattern, cs, fuzzy_distance, name FROM names JOIN
  (SELECT DISTINCT type, pattern, cs, fuzzy_distance FROM asked WHERE type <> 'prefix') ON CASE type
  WHEN 'exact' THEN CASE WHEN cs THEN name = pattern ELSE lower(name) = lower(pattern) END
  WHEN 'substring' THEN CASE WHEN cs THEN contains(name, pattern) ELSE contains(lower(name), lower(pattern)) END
  WHEN 'wildcard' THEN CASE WHEN cs THEN name GLOB pattern ELSE lower(name) GLOB lower(pattern) END
  WHEN 'regex' THEN regexp_matches(name, pattern)
  ELSE CASE WHEN cs THEN levenshtein(name, pattern) ELSE levenshtein(lower(name), lower(pattern)) END <= fuzzy_distance END
"""
DERIVED_SQL["found"] = r"""
SELECT a.*, f.* FROM asked a JOIN hits h ON a.type = h.type AND a.pattern = h.pattern AND a.cs = h.cs
    AND a.fuzzy_distance = h.fuzzy_distance JOIN files f ON f.name = h.name
UNION ALL
SELECT a.*, f.* FROM asked a JOIN files f ON a.type = 'prefix' AND starts_with(f.path, a.pattern)
"""
DERIVED_SQL["scored"] = r"""
SELECT *, CAST(CASE WHEN pattern = '' THEN 0 ELSE
  CASE WHEN (CASE WHEN cs THEN name ELSE lower(name) END) = (CASE WHEN cs THEN pattern ELSE lower(pattern) END) THEN 100
       WHEN starts_with(CASE WHEN cs THEN name ELSE lower(name) END, CASE WHEN cs THEN pattern ELSE lower(pattern) END) THEN 50
       WHEN contains(CASE WHEN cs THEN name ELSE lower(name) END, CASE WHEN cs THEN pattern ELSE lower(pattern) END) THEN 25
       ELSE 0 END + CASE WHEN size < 1024 THEN 10 WHEN size < 1048576 THEN 5 ELSE 0 END END AS INT) AS score
FROM found
WHERE (len(extensions) = 0 OR (NOT is_dir AND list_contains(extensions, extension)))
  AND ((min_size IS NULL AND max_size IS NULL) OR NOT is_dir)
  AND (min_size IS NULL OR size >= min_size) AND (max_size IS NULL OR size <= max_size)
"""
MANY_SQL = f"""
SELECT query_id, CAST(rank AS INT) AS rank, score, {ROW}
FROM (SELECT *, row_number() OVER (PARTITION BY type, pattern, cs, extensions, min_size, max_size, fuzzy_distance
        ORDER BY score DESC, path) AS rank FROM scored) r
JOIN (SELECT * FROM read_log WHERE error IS NULL) l ON l.type = r.type AND l.pattern = r.pattern AND l.cs = r.cs
  AND l.extensions = r.extensions AND l.min_size IS NOT DISTINCT FROM r.min_size
  AND l.max_size IS NOT DISTINCT FROM r.max_size AND l.fuzzy_distance = r.fuzzy_distance
WHERE rank <= 20
"""


@query("sea17_search_many", MANY_SQL)
def _(spark, sf_dir):
    return _many(spark, sf_dir, 20)


@query("sea17_search_many_large_log", MANY_SQL)
def _(spark, sf_dir):
    """The plan for a query table that is too large to broadcast."""
    return _many(spark, sf_dir, 20, broadcast_bytes=1)


@query(
    "sea18_fuzzy_join",
    """
SELECT DISTINCT name, lower(pattern) AS pattern FROM names, (SELECT DISTINCT pattern FROM read_log
  WHERE error IS NULL AND pattern <> '') WHERE levenshtein(name, lower(pattern)) <= 3
""",
)
def _(spark, sf_dir):
    parsed = query_table.parse_queries(spread(workload.query_log(spark, sf_dir)))
    patterns = parsed.filter(F.col("error").isNull() & (F.col("pattern") != ""))
    return fuzzy_join(
        workload.files(spark, sf_dir), patterns.select(F.lower("pattern").alias("pattern")), 3
    )


DOC_WORDS_SQL = r"SELECT DISTINCT unnest(string_split_regex(lower({c}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM {t}"


@query(
    "sea18_fuzzy_join_words",
    f"""
SELECT a.word AS name, b.word AS pattern FROM ({DOC_WORDS_SQL.format(c='html', t='pages')}) a,
  ({DOC_WORDS_SQL.format(c='text', t='benchmark')}) b
WHERE abs(strlen(a.word) - strlen(b.word)) <= 1 AND levenshtein(a.word, b.word) <= 1
""",
)
def _(spark, sf_dir):
    def words(table, column):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return rows.select(F.explode(F.split(F.lower(column), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("word"))

    return fuzzy_join(
        words("pages", "html").withColumnRenamed("word", "name"),
        words("benchmark", "text").withColumnRenamed("word", "pattern"),
        1,
    )


# Ranking

@on_files(
    "rnk1_score_name",
    """
SELECT path, CAST(CASE WHEN lower(name) = 'config' THEN 100 WHEN starts_with(lower(name), 'config') THEN 50
  WHEN contains(lower(name), 'config') THEN 25 ELSE 0 END AS INT) AS folded,
  CAST(CASE WHEN name = 'config' THEN 100 WHEN contains(name, 'config') THEN 25 ELSE 0 END AS INT) AS plain FROM files
""",
)
def _(files):
    wanted = F.lit("config")
    return files.select(
        "path",
        scoring.score_name(F.col("name"), wanted).alias("folded"),
        scoring.score_name(F.col("name"), wanted, False, True).alias("plain"),
    )


@on_files(
    "rnk2_score_size",
    "SELECT path, CAST(CASE WHEN size < 1024 THEN 10 WHEN size < 1048576 THEN 5 ELSE 0 END AS INT) AS score FROM files",
)
def _(files):
    return files.select("path", scoring.score_size(F.col("size")).alias("score"))


@on_files("rnk3_score_recency", "SELECT path, CAST(0 AS INT) AS score FROM files")
def _(files):
    return files.select("path", scoring.score_recency(F.col("modified_time")).alias("score"))


@on_files("rnk4_rank", f"SELECT {ROW}, CAST({SCORE_SQL.format(q='readme')} AS INT) AS score FROM files")
def _(files):
    return rank.rank(files, "README", prefer_recent=True)


TOP_SQL = f"""
SELECT {ROW}, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM (
  SELECT *, CAST({SCORE_SQL.format(q='config')} AS INT) AS score FROM files
  WHERE contains(lower(name), 'config') AND {_listed(['.go'])} AND size >= 1024)) WHERE rank <= 50
"""


@on_files("rnk5_top_k", TOP_SQL)
def flagship(files):
    """Name search, extension and size filter, ranking, top 50."""
    found = s.search_name(files, "config", ordered=False)
    found = p.apply_filters(found, p.has_any_extension(".go"), p.min_size(1024))
    return _numbered(rank.top_k(rank.with_score(found, "config"), 50))


@on_files(
    "rnk5_not_shown",
    "SELECT greatest(count(*) - 50, 0) AS not_shown FROM files WHERE contains(lower(name), 'config')",
)
def _(files):
    return rank.not_shown(s.search_name(files, "config", ordered=False), 50)


@on_files("rnk6_sort_by_path", f"SELECT {ROW} FROM files")
def _(files):
    return rank.sort_by_path(files)


# Statistics

STATS = {
    "agg1_count_files": (stats.count_files, "SELECT count(*) AS count FROM files"),
    "agg2_index_stats": (
        stats.index_stats,
        "SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size FROM files",
    ),
    "agg3_catalog_stats": (
        stats.catalog_stats,
        "SELECT count(*) FILTER (NOT is_dir) AS file_count, count(*) FILTER (is_dir) AS directory_count, "
        "count(*) AS total_count, CAST(sum(size) FILTER (NOT is_dir) AS BIGINT) AS total_size FROM files",
    ),
    "agg4_prefix_count": (
        lambda f: stats.prefix_count(f, "/hig/cust"),
        "SELECT count(*) AS count FROM files WHERE starts_with(path, '/hig/cust')",
    ),
    "agg5_has_prefix": (
        lambda f: stats.has_prefix(f, "/low/cust9"),
        "SELECT count(*) > 0 AS found FROM files WHERE starts_with(path, '/low/cust9')",
    ),
    "agg6_count_regular_files": (stats.count_regular_files, "SELECT count(*) AS count FROM files WHERE NOT is_dir"),
    "agg7_stats_by_extension": (
        stats.stats_by_extension,
        "SELECT extension, count(*) AS total_count, count(*) FILTER (is_dir) AS directory_count, "
        "CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(size) // count(*) AS BIGINT) AS average_size "
        "FROM files GROUP BY extension",
    ),
}
for _name, (_function, _sql) in STATS.items():
    on_files(_name, _sql)(_function)

PREFIXES_SQL = "SELECT DISTINCT concat('/urg/cust', c_custkey % 200, CASE WHEN c_custkey % 3 = 0 THEN '/' ELSE '' END) AS prefix FROM customer"
DERIVED_SQL["prefixes"] = PREFIXES_SQL


def _prefixes(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    end = "CASE WHEN c_custkey % 3 = 0 THEN '/' ELSE '' END"
    return customer.select(F.expr(f"concat('/urg/cust', c_custkey % 200, {end})").alias("prefix")).distinct()


@query(
    "agg4_prefix_counts",
    "SELECT prefix, count(path) AS count FROM prefixes LEFT JOIN files ON starts_with(path, prefix) GROUP BY prefix",
)
def _(spark, sf_dir):
    return stats.prefix_counts(workload.files(spark, sf_dir), _prefixes(spark, sf_dir))


@query(
    "agg5_has_prefixes",
    "SELECT DISTINCT prefix FROM prefixes JOIN files ON starts_with(path, prefix)",
)
def _(spark, sf_dir):
    return stats.has_prefixes(workload.files(spark, sf_dir), _prefixes(spark, sf_dir))


DERIVED_SQL["all_beginnings"] = """
SELECT substr(path, 1, CAST(n AS BIGINT)) AS prefix, count(*) AS paths
FROM (SELECT path, unnest(range(0, length(path) + 1)) AS n FROM files) GROUP BY 1
"""
DERIVED_SQL["all_folders"] = (
    "SELECT DISTINCT prefix FROM (SELECT concat(path, '/') AS prefix FROM files "
    "UNION ALL SELECT path FROM files UNION ALL SELECT substr(path, 1, length(path) - length(name)) FROM files)"
)


def _all_folders(spark, sf_dir):
    """A table of prefixes that grows with the catalog: each path, with a slash, and its folder."""
    folder = F.expr("substring(path, 1, char_length(path) - char_length(name))")
    each = F.explode(F.array(F.concat("path", F.lit("/")), "path", folder))
    return workload.files(spark, sf_dir).select(each.alias("prefix")).distinct()


@query(
    "agg4_prefix_counts_large_table",
    "SELECT prefix, coalesce(paths, 0) AS count FROM all_folders LEFT JOIN all_beginnings USING (prefix)",
)
def _(spark, sf_dir):
    """The way of a table too large to broadcast."""
    return stats.prefix_counts(workload.files(spark, sf_dir), _all_folders(spark, sf_dir), 0)


@query("agg5_has_prefixes_large_table", "SELECT prefix FROM all_folders SEMI JOIN all_beginnings USING (prefix)")
def _(spark, sf_dir):
    return stats.has_prefixes(workload.files(spark, sf_dir), _all_folders(spark, sf_dir), 0)


# Merges: incoming rows come from line items, two thirds of them for paths of the catalog

_INCOMING = """
SELECT concat(substr(path, 1, length(path) - length(name)), CASE WHEN l_partkey % 3 = 0 THEN 'new.txt' ELSE name END) AS path,
  CAST(floor(l_extendedprice) AS BIGINT) AS size, l_shipdate AS modified_time, (l_partkey % 7 = 0) AS is_dir,
  l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS flag
FROM lineitem JOIN files ON concat('o', l_orderkey) = split_part(path, '/', 4)
"""
_DERIVED_NAMES = r"regexp_extract(path, '[^/]*$', 0) AS name, regexp_extract(path, '\.[^./]*$', 0) AS extension"
DERIVED_SQL["incoming_raw"] = _INCOMING
DERIVED_SQL["incoming"] = f"""
SELECT *, {_DERIVED_NAMES} FROM (SELECT *, row_number() OVER (PARTITION BY path
  ORDER BY seq DESC, size DESC, modified_time DESC, is_dir DESC) AS rn FROM incoming_raw) WHERE rn = 1
"""
DERIVED_SQL["returned"] = "SELECT DISTINCT path FROM incoming_raw WHERE flag = 'R'"


def _incoming(spark, sf_dir):
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sql = _INCOMING.replace("FROM lineitem JOIN files", "FROM {lineitem} JOIN {files}")
    return spark.sql(sql, lineitem=lineitem, files=workload.files(spark, sf_dir))


def _incoming_rows(spark, sf_dir):
    return catalog_from_manifest(_incoming(spark, sf_dir), keep=["seq"])


def _returned(spark, sf_dir):
    return _incoming(spark, sf_dir).filter("flag = 'R'").select("path")


@query("mrg1_upsert", f"SELECT {ROW} FROM files ANTI JOIN incoming USING (path) UNION ALL SELECT {ROW} FROM incoming")
def _(spark, sf_dir):
    return merge.upsert(workload.files(spark, sf_dir), _incoming_rows(spark, sf_dir), ["seq"])


DERIVED_SQL["newest_incoming"] = f"""
SELECT *, {_DERIVED_NAMES} FROM (SELECT *, row_number() OVER (PARTITION BY path
  ORDER BY modified_time DESC, size DESC, is_dir DESC) AS rn FROM incoming_raw) WHERE rn = 1
"""


@query(
    "mrg1_upsert_default",
    f"SELECT {ROW} FROM files ANTI JOIN newest_incoming USING (path) UNION ALL SELECT {ROW} FROM newest_incoming",
)
def _(spark, sf_dir):
    """Without an order column the row modified last stays, one per path."""
    return merge.upsert(workload.files(spark, sf_dir), _incoming_rows(spark, sf_dir))


@query(
    "mrg2_update_existing",
    f"SELECT {ROW} FROM files ANTI JOIN incoming USING (path) UNION ALL "
    f"SELECT {ROW} FROM incoming SEMI JOIN files USING (path)",
)
def _(spark, sf_dir):
    rows = _incoming_rows(spark, sf_dir)
    return merge.update_existing(workload.files(spark, sf_dir), rows, ["seq"])[0]


@query(
    "mrg2_update_report",
    "SELECT i.path, f.path IS NOT NULL AS found FROM incoming i LEFT JOIN files f ON i.path = f.path",
)
def _(spark, sf_dir):
    rows = _incoming_rows(spark, sf_dir)
    return merge.update_existing(workload.files(spark, sf_dir), rows, ["seq"])[1]


@query("mrg3_remove", f"SELECT {ROW} FROM files ANTI JOIN returned USING (path)")
def _(spark, sf_dir):
    return merge.remove(workload.files(spark, sf_dir), _returned(spark, sf_dir))


@query(
    "mrg3_remove_report",
    "SELECT r.path, f.path IS NOT NULL AS found FROM returned r LEFT JOIN files f ON r.path = f.path",
)
def _(spark, sf_dir):
    return merge.found_report(workload.files(spark, sf_dir), _returned(spark, sf_dir))


# A catalog of home directories that the change log touches in part

_HOME = """
SELECT concat('/u', c_custkey, '/f', c_custkey % 5, CASE WHEN c_custkey % 2 = 0 THEN '.go' ELSE '.txt' END) AS path,
  CAST(floor(c_acctbal) AS BIGINT) AS size, CAST('2023-12-31 00:00:00' AS {ntz}) AS modified_time,
  false AS is_dir FROM {customer}
"""
DERIVED_SQL["home"] = f"SELECT *, {_DERIVED_NAMES} FROM ({_HOME.format(ntz='TIMESTAMP', customer='customer')})"
DERIVED_SQL["decisive"] = f"""
SELECT *, {_DERIVED_NAMES} FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS rn
  FROM changes WHERE op NOT IN ('create', 'modify') OR size IS NOT NULL) WHERE rn = 1
"""


def _home(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sql = _HOME.format(ntz="TIMESTAMP_NTZ", customer="{customer}")
    return catalog_from_manifest(spark.sql(sql, customer=customer))


@query(
    "mrg4_apply_changes",
    f"SELECT {ROW} FROM home ANTI JOIN decisive USING (path) UNION ALL "
    f"SELECT {ROW} FROM decisive WHERE op IN ('create', 'modify')",
)
def _(spark, sf_dir):
    return merge.apply_changes(_home(spark, sf_dir), workload.changes(spark, sf_dir))


# Change logs and debouncing

CHANGE_ROW = "path, ts, seq, op, size, modified_time, is_dir"


def _sessions_sql(source: str, hours: int) -> str:
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, island ORDER BY ts DESC, seq DESC) AS rn FROM (
  SELECT *, sum(begins) OVER (PARTITION BY path ORDER BY ts, seq) AS island FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, seq) > INTERVAL {hours} HOUR THEN 1 ELSE 0 END AS begins
    FROM {source}))) WHERE rn = 1
"""


DERIVED_SQL["watched"] = (
    "SELECT * FROM changes WHERE NOT (regexp_matches(path, '[.](tmp|swp|bak)$') OR contains(path, '/.') OR ends_with(path, '~'))"
)
DERIVED_SQL["sessions"] = _sessions_sql("changes", 48)
DERIVED_SQL["watched_sessions"] = _sessions_sql("watched", 48)
DERIVED_SQL["settled"] = """
SELECT * FROM watched_sessions WHERE ts + INTERVAL 48 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM watched)
"""


def _plain_times(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables have them."""
    times = [c for c in ("ts", "settled_at", "modified_time") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def _known_size(df: DataFrame) -> DataFrame:
    return df.withColumn("size", F.coalesce("size", F.lit(-1)))


CHANGE_SHOWN = "path, ts, seq, op, coalesce(size, -1) AS size, modified_time, is_dir"


@query("str1_debounce", f"SELECT {CHANGE_SHOWN}, ts + INTERVAL 48 HOUR AS settled_at FROM sessions")
def _(spark, sf_dir):
    return _known_size(_plain_times(d.debounce(workload.changes(spark, sf_dir), DELAY)))


DERIVED_SQL["quick_sessions"] = _sessions_sql("changes", 1)


@query(
    "str1_debounce_short_delay",
    f"SELECT {CHANGE_SHOWN}, ts + INTERVAL 1 HOUR AS settled_at FROM quick_sessions",
)
def _(spark, sf_dir):
    return _known_size(
        _plain_times(d.debounce(workload.changes(spark, sf_dir), timedelta(hours=1)))
    )


AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
DERIVED_SQL["tail"] = f"SELECT * FROM changes WHERE ts <= {AS_OF_SQL} AND ts + INTERVAL 48 HOUR > {AS_OF_SQL}"


def _log(spark, sf_dir):
    log = workload.changes(spark, sf_dir)
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


@query("str2_pending", "SELECT count(DISTINCT path) AS pending FROM tail")
def _(spark, sf_dir):
    return d.pending(_log(spark, sf_dir), DELAY, AS_OF)


@query(
    "str3_flush",
    f"SELECT {CHANGE_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS rn FROM tail) WHERE rn = 1",
)
def _(spark, sf_dir):
    return _known_size(_plain_times(d.flush(_log(spark, sf_dir), DELAY, AS_OF)))


DERIVED_SQL["seen"] = f"SELECT * FROM changes WHERE ts <= {AS_OF_SQL}"
DERIVED_SQL["seen_sessions"] = _sessions_sql("seen", 48)


@query(
    "str4_discard_pending",
    f"SELECT {CHANGE_SHOWN}, ts + INTERVAL 48 HOUR AS settled_at FROM seen_sessions WHERE ts + INTERVAL 48 HOUR <= {AS_OF_SQL}",
)
def _(spark, sf_dir):
    return _known_size(_plain_times(d.discard_pending(_log(spark, sf_dir), DELAY, AS_OF)))


@query("str5_filter_ignored", f"SELECT {CHANGE_SHOWN} FROM watched")
def _(spark, sf_dir):
    return _known_size(change_log.filter_ignored(workload.changes(spark, sf_dir)))


_RAW = """
SELECT event_id AS seq, ts, concat('/u', user_id, '/f', event_id % 5) AS path,
  CASE event_type WHEN 'signup' THEN {list}('create', 'write'{end} WHEN 'view' THEN {list}('write', 'chmod'{end}
    WHEN 'click' THEN {list}('chmod'{end} WHEN 'purchase' THEN {list}('rename', 'create'{end} ELSE {list}('remove'{end} END AS flags,
  CAST(event_id AS BIGINT) AS size, ts AS modified_time, false AS is_dir FROM {events}
"""
DERIVED_SQL["raw_changes"] = _RAW.format(list="[", end="]", events="events").replace("[(", "[")


def _raw_changes(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sql = _RAW.format(list="array", end=")", events="{events}")
    return spark.sql(sql, events=events)


RAW_SQL = """
SELECT seq * 5 + pos AS seq, ts, path, CASE flag WHEN 'create' THEN 'create' WHEN 'write' THEN 'modify' ELSE 'delete' END AS op,
  size, modified_time, is_dir
FROM raw_changes JOIN (VALUES ('create', 1), ('write', 2), ('remove', 3), ('rename', 4)) v(flag, pos) ON list_contains(flags, flag)
"""


@query("src10_map_raw_changes", RAW_SQL)
def _(spark, sf_dir):
    return change_log.map_raw_changes(_raw_changes(spark, sf_dir))


def _finished(stream) -> None:
    stream.awaitTermination()


@query("src10_read_changes", RAW_SQL)
def _(spark, sf_dir):
    """The same through a stream over a folder of raw event files."""
    folder = scratch_path(spark, "raw-changes")
    out = scratch_path(spark, "changes")
    raw = _raw_changes(spark, sf_dir)
    raw.withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "modified_time")}).write.parquet(folder)
    stream = change_log.read_changes(spark, folder)
    _finished(
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    return _plain_times(spark.read.schema(stream.schema).parquet(out))


def _changes_stream(spark, sf_dir):
    """``changes`` as a stream over the events file."""
    events = f"{sf_dir}/events.parquet"
    stream = (
        spark.readStream.schema(spark.read.parquet(events).schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return workload.changes_of(spark, stream)


@query("str1_debounce_stream", f"SELECT {CHANGE_SHOWN}, ts + INTERVAL 48 HOUR AS settled_at FROM settled")
def _(spark, sf_dir):
    out = scratch_path(spark, "settled")
    settled = d.debounce_stream(
        change_log.filter_ignored(_changes_stream(spark, sf_dir)), LATENESS, DELAY
    )
    _finished(
        settled.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    return _known_size(_plain_times(spark.read.schema(settled.schema).parquet(out)))


def _decisive_sql(source: str) -> str:
    return f"""
SELECT *, {_DERIVED_NAMES} FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS rn2
  FROM {source} WHERE op NOT IN ('create', 'modify') OR size IS NOT NULL) WHERE rn2 = 1
"""


DERIVED_SQL["settled_decisive"] = _decisive_sql("settled")
DERIVED_SQL["drained_decisive"] = _decisive_sql("watched_sessions")


def _maintained(spark, sf_dir, merge_every, stream=None, lateness=LATENESS, drained=False):
    folder = scratch_path(spark, "catalog")
    snapshot.save_catalog(_home(spark, sf_dir), folder)
    _finished(
        maintain.maintain_catalog(
            _changes_stream(spark, sf_dir) if stream is None else stream,
            folder,
            scratch_path(spark, "checkpoint"),
            lateness,
            DELAY,
            merge_every,
            {"availableNow": True},
        )
    )
    if drained:
        maintain.drain(spark, folder)
    return _plain_times(maintain.current_catalog(spark, folder))


MAINTAINED_SQL = f"""
SELECT {ROW} FROM home ANTI JOIN settled_decisive USING (path) UNION ALL
SELECT {ROW} FROM settled_decisive WHERE op IN ('create', 'modify')
"""
DRAINED_SQL = MAINTAINED_SQL.replace("settled_decisive", "drained_decisive")


@query("str6_drain", DRAINED_SQL)
def _(spark, sf_dir):
    """After a drain the catalog is what one batch over all changes gives."""
    return _maintained(spark, sf_dir, 1, drained=True)


def _out_of_order(spark, sf_dir):
    """All changes as a stream of four batches, each with changes of any time."""
    folder = scratch_path(spark, "shuffled-changes")
    rows = workload.changes(spark, sf_dir)
    for part in range(4):
        rows.filter(F.pmod(F.xxhash64("seq"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("str6_maintain_catalog_out_of_order", DRAINED_SQL)
def _(spark, sf_dir):
    """The changes come in four batches in any order, and no lateness is allowed for: none is lost."""
    return _maintained(spark, sf_dir, 1, _out_of_order(spark, sf_dir), timedelta(0), drained=True)


@query("str6_maintain_catalog", MAINTAINED_SQL)
def _(spark, sf_dir):
    return _maintained(spark, sf_dir, 1)


@query("str6_maintain_catalog_merge_later", MAINTAINED_SQL)
def _(spark, sf_dir):
    """Changes wait beside the saved version and are applied when it is read."""
    return _maintained(spark, sf_dir, 1_000_000)


# Sources and sinks

@query(
    "src2_catalog_from_manifest",
    r"""
SELECT path, name, size, modified_time, is_dir, regexp_extract(name, '\.[^.]*$', 0) AS extension
FROM (SELECT url AS path, regexp_extract(rtrim(url, '/'), '[^/]*$', 0) AS name, CAST(strlen(html) AS BIGINT) AS size,
  CASE WHEN page_id % 7 = 0 THEN TIMESTAMP '1970-01-01' ELSE TIMESTAMP '2024-01-01' END AS modified_time,
  page_id % 10 = 0 AS is_dir FROM pages)
""".replace("\\\\", "\\"),
)
def _(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "url",
        F.octet_length("html").alias("bytes"),
        F.when(F.col("page_id") % 7 != 0, _ntz("2024-01-01")).alias("mtime"),
        (F.col("page_id") % 10 == 0).alias("dir"),
    )
    return catalog_from_manifest(pages, "url", "bytes", "mtime", "dir")


def _saved(spark, sf_dir, **options) -> str:
    folder = scratch_path(spark, "catalog")
    snapshot.save_catalog(workload.files(spark, sf_dir), folder, **options)
    return folder


@query("src4_save_catalog", "SELECT count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size, '1.0' AS version FROM files")
def _(spark, sf_dir):
    folder = _saved(spark, sf_dir)
    manifests = spark.read.schema(snapshot.MANIFEST_SCHEMA).json(f"{folder}/manifests")
    return manifests.select("file_count", "total_size", "version")


@query("src5_load_catalog", f"SELECT {ROW} FROM files")
def _(spark, sf_dir):
    return snapshot.load_catalog(spark, _saved(spark, sf_dir))


def _document(spark, sf_dir, copies: int, pretty: bool = False) -> str:
    """The catalog as one JSON document in parts, written by Spark; with ``copies`` every path comes so
    often, each time with a larger size."""
    files = workload.files(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    files = files.withColumn("size", F.col("size") + F.col("copy"))
    totals = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("path").alias("least")).first()
    stamp = F.date_format("modified_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_time")
    entry = F.struct("path", "name", "size", stamp, "is_dir", "extension")
    is_first = (F.col("copy") == 1) & (F.col("path") == totals.least)
    comma = F.when(is_first, F.lit("")).otherwise(F.lit(","))
    body = files.select(
        "copy", "path", F.concat(comma, F.to_json(entry, {"pretty": str(pretty).lower()})).alias("value")
    )
    head = f'{{"version":"1.0","created_at":"2024-01-01T00:00:00Z","file_count":{totals.n},"files":['
    tail = f'],"total_size":{totals.bytes},"compressed":false}}'
    ends = spark.createDataFrame([(0, "", head), (copies + 1, "", tail)], "copy int, path string, value string")
    folder = scratch_path(spark, "document")
    order = ["copy", "path"]
    whole = body.unionByName(ends).repartitionByRange(*order).sortWithinPartitions(*order)
    whole.select("value").write.text(folder)
    return folder


def _document_sql(copies: int) -> str:
    return f"SELECT path, name, size + {copies} AS size, modified_time, is_dir, extension FROM files"


@query("src5_import_json", _document_sql(1))
def _(spark, sf_dir):
    return _plain_times(snapshot.import_json(spark, _document(spark, sf_dir, 1)))


@query("src5_import_json_pretty", _document_sql(1))
def _(spark, sf_dir):
    """Entries over many lines."""
    return _plain_times(snapshot.import_json(spark, _document(spark, sf_dir, 1, pretty=True)))


@query("src5_import_json_repeated_path", _document_sql(3))
def _(spark, sf_dir):
    """The later entry of a path stays."""
    return _plain_times(snapshot.import_json(spark, _document(spark, sf_dir, 3)))


@query("src6_validate_catalog", "SELECT count(*) AS count FROM files")
def _(spark, sf_dir):
    folder = _saved(spark, sf_dir, compress=False)
    snapshot.validate_catalog(spark, folder)
    return stats.count_files(snapshot.load_catalog(spark, folder))


@query("src7_backup_catalog", f"SELECT {ROW} FROM files")
def _(spark, sf_dir):
    return snapshot.load_catalog(spark, snapshot.backup_catalog(spark, _saved(spark, sf_dir)))


@query("src8_clear_catalog", f"SELECT {ROW} FROM files WHERE false")
def _(spark, sf_dir):
    folder = _saved(spark, sf_dir)
    snapshot.clear_catalog(spark, folder)
    return _plain_times(snapshot.load_catalog(spark, folder))


def _tree(spark, sf_dir) -> str:
    """A folder per thousand customers and nation, written by Spark."""
    folder = scratch_path(spark, "tree")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    block = F.floor(F.col("c_custkey") / 1000).alias("block")
    rows = customer.select(block, F.col("c_nationkey").alias("nation"), "c_custkey")
    rows.repartition("block", "nation").write.partitionBy("block", "nation").parquet(folder)
    return folder


DERIVED_SQL["tree"] = """
SELECT DISTINCT concat('/block=', c_custkey // 1000) AS block, concat('/nation=', c_nationkey) AS nation FROM customer
"""
TREE_SQL = """
SELECT '' AS path, '' AS extension, true AS is_dir UNION ALL SELECT DISTINCT block, '', true FROM tree
UNION ALL SELECT concat(block, nation), '', true FROM tree
"""


def _below(df: DataFrame, folder: str) -> DataFrame:
    return df.select(F.substring("path", len(folder) + 1, 1 << 20).alias("path"), "extension", "is_dir")


@query("src1_list_files", TREE_SQL)
def _listed_directories(spark, sf_dir):
    folder = _tree(spark, sf_dir)
    return _below(listing.list_files(spark, [folder]).filter("is_dir"), folder)


@query("src9_index_roots", TREE_SQL)
def _indexed_roots(spark, sf_dir):
    """The tree twice, once from its top and once from a folder in it, and two roots to skip."""
    folder = _tree(spark, sf_dir)
    roots = [folder, "", f"{folder}/missing", f"{folder}/block=0"]
    catalog, _failed = listing.index_roots(spark, roots)
    return _below(catalog.filter("is_dir"), folder)


def _files_per_directory(df: DataFrame, folder: str) -> DataFrame:
    """Number, bytes and newest time of the files of every directory, by extension."""
    directory = F.regexp_extract(F.substring("path", len(folder) + 1, 1 << 20), "^(.*)/[^/]*$", 1)
    return df.filter("NOT is_dir").groupBy(directory.alias("path"), "extension").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("modified_time").alias("newest")
    )


# Sizes, times and the number of part files are not in the tables, so SQL cannot ask for them; tests
# compare with Spark's file-metadata columns.

@query("src1_list_files_per_directory")
def _listed_files(spark, sf_dir, folder=None):
    folder = folder or _tree(spark, sf_dir)
    return _files_per_directory(listing.list_files(spark, [folder]), folder)


@query("src9_index_roots_per_directory")
def _indexed_files(spark, sf_dir, folder=None):
    folder = folder or _tree(spark, sf_dir)
    catalog, _failed = listing.index_roots(spark, [folder, "", f"{folder}/missing", f"{folder}/block=0"])
    return _files_per_directory(catalog, folder)


def _sizes_by_extension(batches):
    """A user function over batches of catalog rows."""
    for batch in batches:
        sums = batch.groupby("extension", as_index=False).agg(rows=("path", "size"), bytes=("size", "sum"))
        yield sums


@on_files(
    "src3_map_files",
    "SELECT extension, count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY extension",
)
def _(files):
    parts = listing.map_files(files, _sizes_by_extension, "extension string, rows long, bytes long")
    return parts.groupBy("extension").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


@query("udf2_scan_with_callback", "SELECT count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes FROM files")
def _(spark, sf_dir):
    """A user function is called with every row; here it adds up what it sees."""
    context = spark.sparkContext
    rows, total = context.accumulator(0), context.accumulator(0)

    def seen(row):
        rows.add(1)
        total.add(row["size"])

    listing.scan_with_callback(workload.files(spark, sf_dir), seen)
    return spark.createDataFrame([(rows.value, total.value)], "rows long, bytes long")


@on_files("udf1_row_predicate", f"SELECT {ROW} FROM files WHERE size % 7 = 3 AND length(name) > 8")
def _(files):
    own = (F.col("size") % 7 == 3) & (F.char_length("name") > 8)
    return p.apply_filters(files, own)


@query(
    "udf3_deliver_changes",
    "SELECT path, 'upsert' AS kind FROM settled_decisive WHERE op IN ('create', 'modify') UNION ALL "
    "SELECT path, 'delete' AS kind FROM settled_decisive WHERE op NOT IN ('create', 'modify')",
)
def _(spark, sf_dir):
    out = scratch_path(spark, "delivered")

    def sink(kind):
        def write(frame, batch_id):
            target = f"{out}/batch={batch_id}/kind={kind}"
            frame.select("path").write.mode("overwrite").parquet(target)

        return write

    settled = d.debounce_stream(
        change_log.filter_ignored(_changes_stream(spark, sf_dir)), LATENESS, DELAY
    )
    _finished(
        maintain.deliver_changes(
            settled, sink("upsert"), sink("delete"), scratch_path(spark, "checkpoint"), {"availableNow": True}
        )
    )
    return spark.read.parquet(out).select("path", "kind")


@query("udf3_deliver_changes_out_of_order", DRAINED_SQL)
def _(spark, sf_dir):
    """A copy of the catalog, kept by nothing but what user functions are handed, with changes in any order."""
    folder, out = scratch_path(spark, "catalog"), scratch_path(spark, "delivered")
    snapshot.save_catalog(_home(spark, sf_dir), folder)

    def sink(kind):
        def write(frame, number):
            frame.write.mode("overwrite").parquet(f"{out}/number={number}/kind={kind}")

        return write

    sinks = {"on_upsert": sink("upsert"), "on_delete": sink("delete")}
    _finished(
        maintain.maintain_catalog(
            _out_of_order(spark, sf_dir), folder, scratch_path(spark, "checkpoint"), timedelta(0), DELAY,
            trigger={"availableNow": True}, **sinks,
        )
    )
    maintain.drain(spark, folder, **sinks)
    delivered = spark.read.option("mergeSchema", True).parquet(out)
    others = [c for c in CATALOG_COLUMNS if c != "path"]
    last = delivered.groupBy("path").agg(F.max_by(F.struct("kind", *others), "number").alias("last"))
    rows = last.select("path", "last.*")
    return _plain_times(merge.replace_paths(_home(spark, sf_dir), rows, rows.filter("kind = 'upsert'")))
