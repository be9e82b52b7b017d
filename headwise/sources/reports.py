"""Small result tables: CSV round trips, reports with differing columns, run packages and their manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(frame: DataFrame, path: str, mode: str = "overwrite") -> str:
    frame.write.mode(mode).option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a declared schema; NaN becomes NULL, so a missing prediction is missing whatever wrote it."""
    frame = spark.read.schema(schema).option("header", True).csv(path)
    floats = [f.name for f in frame.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return frame.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def union_reports(reports: list[DataFrame]) -> DataFrame:
    """Stack reports whose columns differ; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def write_package(datasets: dict[str, DataFrame], base: str, run_stamp: str) -> dict[str, str]:
    """Write every data set of a run under its own stamped name."""
    return {
        name: write_csv(frame, f"{base.rstrip('/')}/{name}_{run_stamp}.csv") for name, frame in datasets.items()
    }


def write_forecast_run(outputs: dict[str, DataFrame], base: str, model_name: str, run_stamp: str) -> dict[str, str]:
    """Write the outputs of a model run, each under its own name, model and run; a run that is repeated replaces only itself."""
    paths = {name: f"{base.rstrip('/')}/{name}/model_name={model_name}/run={run_stamp}" for name in outputs}
    for name, frame in outputs.items():
        frame.drop("model_name").write.mode("overwrite").parquet(paths[name])
    return paths


def package_manifest(datasets: dict[str, DataFrame], run_stamp: str) -> DataFrame:
    """One row per data set: name, file, number of rows."""
    return union_reports([
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("dataset_name"), F.lit(f"{name}_{run_stamp}.csv").alias("file_name"), "row_count"
        )
        for name, frame in datasets.items()
    ])
