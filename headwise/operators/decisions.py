"""Decision aggregates: critical lines, hours, segments and vehicles, and the model against its baseline.

Everything starts with one combining aggregate over the predictions. The rankings that follow work on its result, which
has one row per line, hour or vehicle: the size of the fleet, not of the feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.operators.forecast import line_hour_metrics, vehicle_day_metrics
from headwise.schemas import PREDICTION_COLUMNS

PRED, REAL, N = "pred_atraso_aproximado_min", "real_atraso_aproximado_min", "n_registros"
# fixed values: default minimum support
MIN_LINE, MIN_LINE_HOUR, MIN_SEGMENT, MIN_VEHICLE = 10, 5, 5, 10


# an hour column already there, under either name, before one computed from the window
HOUR_SOURCES = {"faixa_horaria": F.col, "hour": F.col, "janela_5min": F.hour}
JUDGED = ["cod_linha", "cod_veiculo", "y_true", "y_pred"]


def ensure_hour(frame: DataFrame) -> DataFrame:
    """The frame with one hour-of-day column, ``hour``: the first source at hand is used, other hour columns leave."""
    sources = [read(name) for name, read in HOUR_SOURCES.items() if name in frame.columns]
    if not sources:
        raise ValueError(f"no column to take the hour from: {', '.join(HOUR_SOURCES)}")
    return frame.select(*[c for c in frame.columns if HOUR_SOURCES.get(c) is not F.col], sources[0].alias("hour"))


def _known_values() -> Column:
    """How many of the judged columns are known in a row."""
    return sum((F.col(c).isNotNull().cast("int") for c in JUDGED), F.lit(0))


def clean_predictions(predictions: DataFrame) -> DataFrame:
    """Rows with line, vehicle, truth and prediction; fails on missing columns."""
    absent = set(JUDGED).difference(predictions.columns)
    if absent:
        raise ValueError(f"predictions lack columns {sorted(absent)}")
    return ensure_hour(predictions.dropna(subset=JUDGED))


def dropped_predictions(predictions: DataFrame) -> DataFrame:
    """How many rows ``clean_predictions`` keeps and drops, in one pass."""
    return predictions.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(_known_values() < len(JUDGED)).alias("rows_dropped"),
    )


def _means(clean: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    return clean.groupBy(*keys).agg(
        *extra, F.avg("y_pred").alias(PRED), F.avg("y_true").alias(REAL), F.count(F.lit(1)).alias(N)
    )


def _supported(frame: DataFrame, minimum: int) -> DataFrame:
    return frame.where(F.col(N) >= minimum)


def _worst_first(metric: str, keys: list[str]) -> list[Column]:
    """Largest metric first, then support, then the whole key: a total order."""
    return [F.desc(metric), F.desc(N), *[F.asc(k) for k in keys]]


def _ranked(frame: DataFrame, metric: str, keys: list[str], source: str) -> DataFrame:
    # one row per line, hour or vehicle comes in here; see the module comment
    position = F.row_number().over(Window.orderBy(*_worst_first(metric, keys)))
    return frame.select(position.alias("rank"), F.lit(source).alias("prediction_source"), "*")


def pred_line_hour(clean: DataFrame, source: str, minimum: int = MIN_LINE_HOUR) -> DataFrame:
    keys = ["cod_linha", "hour"]
    return (
        _supported(_means(clean, keys), minimum)
        .select(F.lit(source).alias("prediction_source"), "*")
        .orderBy(*_worst_first(PRED, keys))
    )


def line_ranking(clean: DataFrame, source: str, minimum: int = MIN_LINE) -> DataFrame:
    return _ranked(_supported(_means(clean, ["cod_linha"]), minimum), PRED, ["cod_linha"], source)


def hour_ranking(clean: DataFrame, source: str, minimum: int = MIN_LINE_HOUR) -> DataFrame:
    return _ranked(_supported(_means(clean, ["hour"]), minimum), PRED, ["hour"], source)


def segment_errors(clean: DataFrame, source: str, minimum: int = MIN_SEGMENT) -> DataFrame:
    """Mean absolute error by line, hour and vehicle."""
    keys = ["cod_linha", "hour", "cod_veiculo"]
    error = F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mean_abs_error")
    return (
        _supported(_means(clean, keys, error), minimum)
        .select(F.lit(source).alias("prediction_source"), "*")
        .orderBy(*_worst_first("mean_abs_error", keys))
    )


def line_hour_compare(model_line_hour: DataFrame, clean_baseline: DataFrame) -> DataFrame:
    """Model means beside baseline means of the same line and hour."""
    base = clean_baseline.groupBy("cod_linha", "hour").agg(
        F.avg("y_pred").alias("baseline_pred_atraso_aproximado_min"),
        F.avg("y_true").alias("baseline_real_atraso_aproximado_min"),
        F.count(F.lit(1)).alias("baseline_n_registros"),
    )
    return model_line_hour.join(base, ["cod_linha", "hour"], "left").withColumn(
        "pred_minus_baseline", F.col(PRED) - F.col("baseline_pred_atraso_aproximado_min")
    )


def vehicle_instability(vehicle_day: DataFrame, source: str, minimum: int = MIN_VEHICLE) -> DataFrame:
    """Mean daily gap between predicted and actual delay of a vehicle, from vehicle-day means."""
    gap = F.abs(F.col("avg_pred_atraso_aproximado_min") - F.col("avg_real_atraso_aproximado_min"))
    per_vehicle = vehicle_day.where(F.col("cod_veiculo").isNotNull()).groupBy("cod_veiculo").agg(
        F.avg("avg_pred_atraso_aproximado_min").alias(PRED),
        F.avg("avg_real_atraso_aproximado_min").alias(REAL),
        F.avg(gap).alias("mean_abs_gap_pred_real"),
        F.sum(N).alias(N),
        F.count_distinct("event_dt").alias("n_dias"),
    )
    return _ranked(_supported(per_vehicle, minimum), "mean_abs_gap_pred_real", ["cod_veiculo"], source)


# data set -> (metric, key columns) of its first row
TOP_OF = {
    "line_ranking": (PRED, ["cod_linha"]),
    "hour_ranking": (PRED, ["hour"]),
    "segment_error": ("mean_abs_error", ["cod_linha", "hour", "cod_veiculo"]),
    "vehicle_instability": ("mean_abs_gap_pred_real", ["cod_veiculo"]),
}


def top_summary(aggregates: dict[str, DataFrame]) -> DataFrame:
    """The worst entry of each aggregate: key text, value, support. Each is a top-1, not a sort of everything."""
    tops = []
    for group, (metric, keys) in TOP_OF.items():
        label = F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
        tops.append(
            aggregates[group].orderBy(*_worst_first(metric, keys)).limit(1).select(
                F.lit(group).alias("comparison_group"), "prediction_source", label.alias("top_key"),
                F.col(metric).alias("top_value"), F.col(N).alias("top_n_registros"),
            )
        )
    first, *rest = tops
    for frame in rest:
        first = first.unionByName(frame)
    return first


def top_compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Worst entries of two runs beside each other."""
    def side(frame: DataFrame, tag: str) -> DataFrame:
        return frame.select(
            "comparison_group", F.col("prediction_source").alias(f"{tag}_source"), F.col("top_key").alias(f"{tag}_key"),
            F.col("top_value").alias(f"{tag}_value"), F.col("top_n_registros").alias(f"{tag}_n_registros"),
        )

    return side(old, "old").join(side(new, "new"), "comparison_group", "full")


def decision_aggregates(
    model: DataFrame,
    baseline: DataFrame | None,
    source: str,
    min_line: int = MIN_LINE,
    min_line_hour: int = MIN_LINE_HOUR,
    min_segment: int = MIN_SEGMENT,
    min_vehicle: int = MIN_VEHICLE,
) -> dict[str, DataFrame]:
    """All decision data sets of a run; without a baseline, all but the comparison with it.

    Pass stored predictions: each data set scans them once.
    """
    clean = clean_predictions(model.select(*PREDICTION_COLUMNS))
    by_line_hour = pred_line_hour(clean, source, min_line_hour)
    by_vehicle_day = vehicle_day_metrics(clean)
    sets = {
        "line_hour_final": by_line_hour,
        "line_ranking": line_ranking(clean, source, min_line),
        "hour_ranking": hour_ranking(clean, source, min_line_hour),
        "segment_error": segment_errors(clean, source, min_segment),
        "vehicle_instability": vehicle_instability(by_vehicle_day, source, min_vehicle),
        "vehicle_day_ref": by_vehicle_day,
        "line_hour_ref": line_hour_metrics(clean),
    }
    if baseline is not None:
        clean_base = clean_predictions(baseline.select(*PREDICTION_COLUMNS))
        sets["line_hour_compare"] = line_hour_compare(by_line_hour, clean_base)
    return sets
