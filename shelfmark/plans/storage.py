"""The shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_steps: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="shelfmark-")
    return _local_folders[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet folder, or ``None`` where there is none; any other trouble is an error."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def step_path(spark: SparkSession) -> str:
    """A path for an intermediate table, which ``delete_steps`` takes away."""
    path = scratch_path(spark, "step")
    _steps.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete_steps(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written so far; returns how many.

    Call it when the results that were built on them have been read or saved.
    """
    paths = _steps.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def reliable(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read back from there.

    Later steps do not recompute it, also when the executors that wrote it are lost.
    """
    path = step_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
