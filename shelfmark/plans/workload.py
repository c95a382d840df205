"""Catalog-shaped tables derived from the star-schema test tables, for Spark and for DuckDB.

``files`` comes from ``orders``, ``changes`` from ``events`` and ``query_log`` from ``customer``, so
each grows with its table; a seventh of the file names carries a customer's number, so the number of
distinct names grows too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FILES = """
WITH n AS (
  SELECT o.*, concat(
    CASE WHEN o.o_orderkey % 7 = 5 THEN concat('Größe_', CAST(o.o_custkey AS {string})) ELSE
    {pick}({list}('config','readme','README','test_utils','Makefile','.env','report','photo','konfig','Config','main','data~'{end},
           CAST(o.o_orderkey % 12 AS INT) + 1) END,
    CASE o.o_orderkey % 97 WHEN 0 THEN '.mp4' WHEN 1 THEN '.mp3' ELSE
    {pick}({list}('.go','.txt','','.md','.jpg','.yaml','.pdf','.zip','.py','.tmp','.tar.gz'{end},
           CAST(o.o_orderkey % 11 AS INT) + 1) END) AS name
  FROM orders o)
SELECT concat('/', lower(substr(o_orderpriority, 3, 3)), '/cust', CAST(o_custkey % 97 AS {string}),
              '/o', CAST(o_orderkey AS {string}), '/', name) AS path,
       name,
       CASE WHEN o_orderkey % 29 = 0 THEN CAST(0 AS BIGINT)
            WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 2000
            ELSE CAST(floor(o_totalprice) AS BIGINT) * (1 + o_orderkey % 1000) END AS size,
       o_orderdate AS modified_time,
       (o_orderkey % 17 = 0) AS is_dir,
       regexp_extract(name, '{dot}[^.]*$', 0) AS extension
FROM n
"""

_CHANGES = """
SELECT event_id AS seq, ts,
       concat('/u', CAST(user_id AS {string}), '/f', CAST(event_id % 5 AS {string}),
              CASE event_id % 7 WHEN 0 THEN '.tmp' WHEN 1 THEN '.go' ELSE '.txt' END) AS path,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'modify' WHEN 'click' THEN 'modify'
                       WHEN 'purchase' THEN 'rename' ELSE 'delete' END AS op,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS size,
       ts AS modified_time,
       (event_id % 11 = 0) AS is_dir
FROM events
"""

_QUERY_LOG = r"""
SELECT c_custkey AS query_id, CASE c_custkey % 23
  WHEN 0 THEN 'config'
  WHEN 1 THEN concat('/urg/cust', CAST(c_custkey % 97 AS {string}))
  WHEN 2 THEN 'test*.md'
  WHEN 3 THEN 'regex:^READ.*{slash}.(txt|md)$'
  WHEN 4 THEN 'fuzzy:config.go'
  WHEN 5 THEN 'exact:README'
  WHEN 6 THEN 'readme case:true'
  WHEN 7 THEN concat('config ext:.go,md size:>1KB size:<=', CAST(1 + c_custkey % 50 AS {string}), 'MB')
  WHEN 8 THEN concat('size:>', CAST(1 + c_custkey % 9 AS {string}), 'MB ext:jpg')
  WHEN 9 THEN '   '
  WHEN 10 THEN 'photo size:5MB'
  WHEN 11 THEN 'fuzzy:konfig.txt fuzzy:1'
  WHEN 12 THEN concat('/med/cust12/o', CAST(c_custkey AS {string}))
  WHEN 13 THEN 'regex:^[a-z]+_'
  WHEN 14 THEN '  *.tar.gz   CASE:true Ext:gz '
  WHEN 15 THEN concat('size:<', CAST(1 + c_custkey % 40 AS {string}), 'KB size:>=1.5KB')
  WHEN 16 THEN concat('o', CAST(c_custkey % 10 AS {string}), ' extension:,txt, fuzzy:9 foo:bar size:>=10')
  WHEN 17 THEN 'regex:^[A-Z]+([.]|$)'
  WHEN 18 THEN '?????? case:true'
  WHEN 20 THEN concat('regex:n', chr(123), '1', chr(125), '?f')
  WHEN 21 THEN 'regex:[*~+]'
  WHEN 22 THEN 'regex:[[:upper:]][[:upper:]].*[[:punct:]]'
  ELSE 'case:true' END AS raw
FROM customer
"""

SPARK = {
    "pick": "element_at", "list": "array", "end": ")", "string": "STRING",
    "dot": r"\\.", "slash": r"\\",
}
DUCKDB = {
    "pick": "list_extract", "list": "[", "end": "]", "string": "VARCHAR",
    "dot": r"\.", "slash": "\\",
}


def _duck_list(sql: str) -> str:
    return sql.replace("[(", "[")


FILES_SQL = _duck_list(_FILES.format(**DUCKDB))
CHANGES_SQL = _CHANGES.format(**DUCKDB)
QUERY_LOG_SQL = _QUERY_LOG.format(**DUCKDB)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    text = sql.format(**SPARK).replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(text, **{table: _table(spark, sf_dir, table)})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "orders", _FILES)


def changes_of(spark: SparkSession, events: DataFrame) -> DataFrame:
    """``changes`` over any frame of events, a stream too."""
    return spark.sql(_CHANGES.format(**SPARK).replace("FROM events", "FROM {events}"), events=events)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "events", _CHANGES)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "customer", _QUERY_LOG)
