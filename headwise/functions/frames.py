"""Helpers over whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(frame: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double: averages of the same rows differ in the last bits with the order of summation."""
    doubles = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return frame.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else frame


def constant_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few literal rows, built inside the JVM."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
