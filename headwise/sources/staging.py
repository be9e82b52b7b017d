"""Written intermediate tables.

Fan-outs (one Gold table feeding many aggregates) are cut by writing the shared input once as Parquet and reading it
back: the copy lives on shared storage, so losing an executor costs a re-read and not a recomputation, the reader gets
exact sizes for its join choices, and each consumer scans only the columns it needs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one is allowed only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="headwise-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_SCOPES: list[str] = []


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Gives every copy staged inside an owner: they lie in one folder, which goes at the end of the run, also after a
    failure. Results are to be written or collected inside."""
    folder = f"{shared_folder(spark)}/headwise/run-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody has written to, in the folder of the current run or else under the shared folder."""
    parent = _SCOPES[-1] if _SCOPES else f"{shared_folder(spark)}/headwise"
    return f"{parent}/{label}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` to shared storage and return a scan of the copy."""
    spark = frame.sparkSession
    path = fresh_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
