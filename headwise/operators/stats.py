"""Exact order statistics and error metrics that stay distributed whatever the group sizes are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def exact_median(frame: DataFrame, value: str, keys: list[str], out: str, accuracy: int = 10000) -> DataFrame:
    """Exact interpolated median per group without holding a group in one place.

    The built-in ``median`` keeps all distinct values of a group in one aggregation buffer. Here a mergeable sketch
    proposes a narrow bracket around the middle, equal values are counted by a hash aggregate, and only the values of the
    region that holds the middle ranks are put in order. The sketch decides how little has to be ordered, never the
    answer: regions are counted exactly, and whichever holds a middle rank is searched. NULLs are ignored, as by
    ``median``.
    """
    data = frame.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    counted = data.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    margin = min(0.5, 4.0 / accuracy)
    bracket = data.groupBy(*keys).agg(
        F.percentile_approx("v", [0.5 - margin, 0.5 + margin], accuracy).alias("edge"),
        F.count(F.lit(1)).alias("n"),
    )
    placed = _attach(counted, bracket, keys, ["edge", "n"]).withColumn(
        "region",
        F.when(F.col("v") < F.col("edge")[0], 0).when(F.col("v") <= F.col("edge")[1], 1).otherwise(2),
    )
    sizes = placed.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("region") == 0, F.col("c"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("region") == 1, F.col("c"))), F.lit(0)).alias("inside"),
    )
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1

    def region_of(rank: Column) -> Column:
        return F.when(rank <= F.col("below"), 0).when(rank <= F.col("below") + F.col("inside"), 1).otherwise(2)

    before = (
        F.when(F.col("region") == 0, F.lit(0))
        .when(F.col("region") == 1, F.col("below"))
        .otherwise(F.col("below") + F.col("inside"))
    )
    searched = _attach(placed, sizes, keys, ["below", "inside"]).where(
        (F.col("region") == region_of(low)) | (F.col("region") == region_of(high))
    )
    ordered = Window.partitionBy(*keys, "region").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = searched.withColumn("upto", before + F.sum("c").over(ordered))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("c") < rank) & (rank <= F.col("upto")), F.col("v")))

    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2.0).alias(out))


def _attach(rows: DataFrame, facts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Add per-group facts: an equi-join on the keys, or a scalar subquery when there is a single group."""
    if keys:
        return rows.join(facts, keys)
    fact = facts.select(F.struct(*columns)).scalar()
    return rows.withColumn("fact", fact).select("*", *[F.col("fact")[c].alias(c) for c in columns]).drop("fact")


def error_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, RMSE, WAPE, median absolute error and safe MAPE per group, over rows where truth and prediction are known.

    WAPE is zero when the truth sums to nothing; MAPE divides by one where the truth is zero.
    """
    y = F.abs("y_true")
    scored = predictions.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()).select(
        *keys, y.alias("y"), F.abs(F.col("y_true") - F.col("y_pred")).alias("e")
    )
    means = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_registros"),
        F.avg("e").alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.when(F.sum("y") < EPS, 0.0).otherwise(F.try_divide(F.sum("e"), F.sum("y"))).alias("wape"),
        (F.avg(F.col("e") / F.when(F.col("y") < EPS, 1.0).otherwise(F.col("y"))) * 100.0).alias("mape_secondary"),
    )
    return means.join(exact_median(scored, "e", keys, "medae"), keys)
