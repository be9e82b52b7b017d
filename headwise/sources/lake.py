"""Bronze, Silver and Gold input and output."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.schemas import BRONZE_DDL, SILVER_PARTITIONS, SILVER_TABLES
from headwise.sources import versions

CORRUPT = "_corrupt_record"


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines with the declared schema: no inference pass. Unparsable lines are kept in ``_corrupt_record``."""
    return (
        spark.read.schema(f"{BRONZE_DDL}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def _date(value: str | dt.date | None) -> dt.date | None:
    # a bad date fails here on the driver, not as an empty result
    return value if value is None or isinstance(value, dt.date) else dt.date.fromisoformat(value)


def _day(value: str | dt.date) -> Column:
    return F.lit(_date(value))


def between_days(frame: DataFrame, first: str | dt.date | None = None, last: str | dt.date | None = None) -> DataFrame:
    """Inclusive, optional bounds on ``event_dt``; typed literals, so a partitioned scan prunes on them."""
    if first is not None:
        frame = frame.where(F.col("event_dt") >= _day(first))
    if last is not None:
        frame = frame.where(F.col("event_dt") <= _day(last))
    return frame


def _partition_folder(spark: SparkSession, values: tuple) -> str:
    """Path of a partition below its table, escaped by the writer's own rule."""
    shown = [None if v is None or v == "" else str(v) for v in values]
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join(named(column, value) for column, value in zip(SILVER_PARTITIONS, shown))


def _drop_stale_folders(spark: SparkSession, path: str, stale: dict[str, str], written: set[str]) -> None:
    """Remove those partitions of the written days that were there before (``stale``) and that this write did not touch: what a
    corrected row has left behind. A folder that the write made is never among them."""
    days = {folder.split("/")[0] for folder in written}
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder, where in stale.items():
        if folder not in written and folder.split("/")[0] in days:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(where), True)


def _partition_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Partition folders of a table as they are named: path below the table -> whole path."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path + "/*=*" * len(SILVER_PARTITIONS))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    whole = [status.getPath().toString() for status in found]
    return {"/".join(w.split("/")[-len(SILVER_PARTITIONS):]): w for w in whole}


def write_silver(table: DataFrame, base: str, name: str, mode: str = "overwrite", fmt: str = "parquet") -> str:
    """Write one Silver table as plain folders by day, message type and company, for readers that know nothing of versions;
    returns its path. ``swap_silver`` is the safe way to replace days: here a writer that dies may leave a day half replaced.

    An overwrite replaces the days present in ``table`` as a whole: partitions that the rows now fill are swapped, and the
    other partitions those days had before go after that. Other days stay. The partitions present are asked for once (days,
    message types and companies: a small set), so ``table`` should be cheap to read twice. REBALANCE gathers each partition
    value into few files and lets adaptive execution split a value that holds a large share of the rows over several writers.
    """
    path = f"{base.rstrip('/')}/{name}"
    spark, replacing = table.sparkSession, mode == "overwrite"
    before, written = {}, set()
    if replacing:
        before = _partition_folders(spark, path)
        written = {_partition_folder(spark, tuple(r)) for r in table.select(*SILVER_PARTITIONS).distinct().collect()}
    (
        table.hint("rebalance", *SILVER_PARTITIONS)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*SILVER_PARTITIONS)
        .format(fmt)
        .save(path)
    )
    if replacing:
        _drop_stale_folders(spark, path, before, written)
    return path


def swap_silver(
    table: DataFrame, base: str, name: str, mode: str = "overwrite", days: Iterable[str | dt.date | None] = (), fmt: str = "parquet",
) -> versions.Commit:
    """Write one Silver table as versioned days: the days of ``table`` and those named in ``days`` are replaced in one step
    (``append`` adds to them), whatever happens to the writer. See ``sources/versions.py``."""
    return versions.write_days(table, f"{base.rstrip('/')}/{name}", SILVER_PARTITIONS, mode, fmt, days)


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan a Hive-style layout with the declared types, so partition values are not re-guessed from folder names."""
    return spark.read.schema(schema).parquet(path)


def load_silver(
    spark: SparkSession,
    base: str,
    first: str | dt.date | None = None,
    last: str | dt.date | None = None,
    schemas: dict[str, T.StructType] | None = None,
) -> dict[str, DataFrame]:
    """The four Silver tables, cut to a day range: of versioned tables only the folders of those days are opened, of plain ones
    the partitions are pruned."""
    loaded = {}
    for name in SILVER_TABLES:
        path = f"{base.rstrip('/')}/{name}"
        if versions.manifest(spark, path) is not None:
            loaded[name] = between_days(versions.read_days(spark, path, _date(first), _date(last)), first, last)
            continue
        reader = spark.read.schema(schemas[name]) if schemas and name in schemas else spark.read
        loaded[name] = between_days(reader.parquet(path), first, last)
    return loaded


def write_gold(gold: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> str:
    """Parquet is partitioned by day; other formats are written flat, as they are exports."""
    if fmt == "parquet":
        (
            gold.hint("rebalance", "event_dt")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("event_dt")
            .parquet(path)
        )
    else:
        gold.write.mode(mode).format(fmt).save(path)
    return path


def read_gold(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    gold = spark.read.parquet(path)
    return gold.select(*columns) if columns else gold
