"""File-catalog analytics on Spark: DataFrames in, DataFrames and Columns out.

``functions`` has column expressions and predicates, ``operators`` searches, ranking, statistics and
merges, ``sources`` listings, snapshots and change logs, ``streaming`` debouncing and upkeep, and
``plans`` size checks, skew handling and the test workload.
"""
