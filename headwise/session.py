"""Session factory used by the tests, the bench and stand-alone runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "headwise",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    checkpoint_dir: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create a session with adaptive execution and ANSI semantics.

    No master, memory or shuffle width is forced: on a cluster those come from the submit command. The number of
    shuffle partitions is only the starting width; adaptive execution coalesces small ones and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
