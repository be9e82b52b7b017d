"""The chain from Silver tables to decisions, with the places where a shared result is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.functions.clock import epoch_sql
from headwise.operators.forecast import (
    LAGGED, baseline_predict, fit_baseline, lag_features, target_next_window, temporal_features, temporal_split,
    test_rows, train_rows,
)
from headwise.operators.gold import build_gold
from headwise.schemas import PREDICTION_COLUMNS
from headwise.sources.staging import stage

FORECAST_COLUMNS = ["event_dt", "janela_5min", "cod_linha", "cod_veiculo", "atraso_aproximado_min"]


def stored_gold(tables: dict[str, DataFrame], zone: str = "UTC") -> DataFrame:
    """Gold as a written table: every later step scans it, several of them more than once."""
    return stage(build_gold(tables, zone), "gold")


def labelled_windows(gold: DataFrame) -> DataFrame:
    """Next-window target and split on the five columns the baselines need. The target is written, as the split and the
    medians scan it; the split itself is then a comparison per row."""
    return temporal_split(stage(target_next_window(gold.select(*FORECAST_COLUMNS)), "target"))


def labelled_features(gold: DataFrame) -> DataFrame:
    """Target, split and model features. Lags and the target share one partitioning and one sort."""
    features = temporal_features(lag_features(gold, LAGGED))
    return temporal_split(stage(target_next_window(features), "features"))


def fitted_baseline(labelled: DataFrame) -> DataFrame:
    """The median table of the training part, stored like any fitted model."""
    return stage(fit_baseline(train_rows(labelled)), "medians")


def baseline_predictions(labelled: DataFrame, levels: int = 3) -> DataFrame:
    return baseline_predict(test_rows(labelled), fitted_baseline(labelled), levels)


def second_model(labelled: DataFrame) -> DataFrame:
    """Deterministic stand-in for a second model (FIXTURES.md 3.5): a damped truth, with some truths missing."""
    truth = F.col("y_true")
    window_no = F.expr(f"{epoch_sql('janela_5min')} div 300")
    known = (window_no + F.col("cod_veiculo") * 13 + F.col("cod_linha") * 7) % 97 != 0
    return (
        test_rows(labelled)
        .withColumn("y_pred", truth * F.lit(0.8) + F.lit(0.1) * (F.col("cod_veiculo") % 5))
        .withColumn("y_true", F.when(known, truth))
        .select(*PREDICTION_COLUMNS)
    )
