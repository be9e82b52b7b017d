"""Forecast models on Spark ML: preparation fitted on the training part, regressors, result contract."""

from __future__ import annotations

from functools import partial
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.operators.encoding import with_target_means
from headwise.operators.forecast import (
    line_hour_metrics, test_rows, train_rows, vehicle_day_metrics,
)
from headwise.operators.stats import error_metrics, exact_median
from headwise.schemas import PREDICTION_COLUMNS
from headwise.sources.staging import stage

SEED = 42
VALIDATION = "is_validation"
CATEGORY_BINS = 256
FOREST_PARTS, PART_SEEDS = 8, 1_000_003
KEPT_WITH_VECTORS = [c for c in PREDICTION_COLUMNS if c != "y_pred"]
# fixed values: features of the window that are known when the next one is predicted
WINDOW_FEATURES = [
    "velocidade_media", "gps_invalid_pct", "qtd_eventos_gps", "qtd_eventos_stop", "max_satelites",
    "headway_referencia_min", "hour", "day_of_week", "is_weekend",
]
LAG_FEATURES = [
    "lag_1_velocidade_media", "lag_1_gps_invalid_pct", "lag_1_qtd_eventos_gps", "lag_1_qtd_eventos_stop",
    "lag_1_headway_referencia_min",
]
CALENDAR_FEATURES = ["cod_linha", "cod_veiculo", "hour", "minute", "day_of_week"]
# fixed values: columns that would tell the model its own answer
FORBIDDEN_FEATURES = {"atraso_aproximado_min", "headway_observado_min", "y_true", "y_pred"}


class ForecastResult(NamedTuple):
    metrics: DataFrame
    baseline_metrics: DataFrame
    predictions: DataFrame
    line_hour_metrics: DataFrame
    vehicle_day_metrics: DataFrame


def check_features(columns: list[str]) -> None:
    """Refuse features that hold the target or the headway it is computed from."""
    leaking = sorted(set(columns) & FORBIDDEN_FEATURES)
    if leaking:
        raise ValueError(f"features leak the target: {leaking}")


def check_result(result: ForecastResult) -> None:
    """Result contract: the required columns of each output."""
    means = ["avg_pred_atraso_aproximado_min", "avg_real_atraso_aproximado_min", "n_registros"]
    required = {
        "metrics": ["mae", "rmse", "wape", "medae"],
        "baseline_metrics": ["mae", "rmse", "wape", "medae"],
        "predictions": ["event_dt", "janela_5min", "cod_linha", "cod_veiculo", "y_true", "y_pred"],
        "line_hour_metrics": ["cod_linha", "faixa_horaria", *means],
        "vehicle_day_metrics": ["event_dt", "cod_veiculo", *means],
    }
    for name, columns in required.items():
        frame = getattr(result, name)
        if not isinstance(frame, DataFrame):
            raise TypeError(f"{name} must be a DataFrame")
        absent = [c for c in columns if c not in frame.columns]
        if absent:
            raise ValueError(f"{name} lacks columns {absent}")


def as_doubles(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.withColumns({f"x_{c}": F.col(c).cast("double") for c in columns})


def training_medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median of every column over the training rows, all columns in one distributed pass; zero where none is known.
    One number per feature reaches the driver."""
    known = as_doubles(train, columns).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"x_{c}").alias("value")) for c in columns])).alias("p")).select("p.*")
    found = {r["feature"]: r["m"] for r in exact_median(known, "value", ["feature"], "m").collect()}
    return {c: found.get(c, 0.0) for c in columns}


def filled(frame: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Every column again as ``filled_<name>``, a double, with the given value where it is NULL."""
    return frame.withColumns({f"filled_{c}": F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def category_indexer(columns: list[str]) -> StringIndexer:
    """Frequency-ordered codes in new columns: the original ids stay. Unseen values get their own code."""
    return StringIndexer(
        inputCols=columns, outputCols=[f"{c}_index" for c in columns], handleInvalid="keep",
        stringOrderType="frequencyDesc",
    )


def regressor(kind: str, **params):
    common = {"featuresCol": "features", "labelCol": "y_true", "predictionCol": "y_pred"}
    if kind == "gbt":  # up to 100 rounds of up to 32 leaves; rounds end early once the validation part stops gaining
        return GBTRegressor(seed=SEED, validationIndicatorCol=VALIDATION, **common, **{
            "maxIter": 100, "maxDepth": 5, **params})
    if kind == "rf":  # trees as deep as the library allows; rows keep their nodes, else every level sends all trees to all tasks
        return RandomForestRegressor(seed=SEED, **common, **{
            "numTrees": 100, "maxDepth": 30, "maxMemoryInMB": 1024, "cacheNodeIds": True, **params})
    if kind == "linear":
        return LinearRegression(**common, **params)
    raise ValueError(f"unknown regressor {kind!r}")


def preparation(features: list[str], categories: list[str] | None = None, scale: bool = True) -> Pipeline:
    """Encode, assemble, standardise. Categories become plain ordinal numbers, most frequent first, beside the target means that
    ``with_target_means`` has given them: without the nominal mark a tree splits both by order, at up to ``maxBins`` places."""
    check_features([*features, *([] if categories is None else categories)])
    stages, inputs = [], [f"filled_{c}" for c in features]
    if categories:
        stages.append(category_indexer(categories))
        plain = ", ".join(f"{c}_index + 0.0D as {c}_code" for c in categories)
        stages.append(SQLTransformer(statement=f"select *, {plain} from __THIS__"))
        inputs += [name for c in categories for name in (f"{c}_code", f"{c}_mean")]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw_features" if scale else "features"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=stages)


def fit_forest(forest: RandomForestRegressor, train: DataFrame) -> list[Model]:
    """The stages that predict with the mean of all trees of a forest.

    One level of all trees at a time leaves most of a cluster waiting, for the driver too. So the trees are dealt to up to
    ``FOREST_PARTS`` forests that are fitted side by side, each with its share of the memory for statistics. A part has two trees
    at least: a single one would be given every feature."""
    trees = forest.getNumTrees()
    parts = max(1, min(FOREST_PARTS, trees // 2))
    if parts == 1:
        return [forest.fit(train)]
    sizes = [len(range(i, trees, parts)) for i in range(parts)]
    members = [forest.copy({
        forest.numTrees: n, forest.seed: forest.getSeed() + i * PART_SEEDS, forest.predictionCol: f"part_{i}",
        forest.maxMemoryInMB: max(1, forest.getMaxMemoryInMB() // parts)}) for i, n in enumerate(sizes)]
    carried = inheritable_thread_target(train.sparkSession)
    with ThreadPool(parts) as pool:
        fitted = pool.map(lambda fit: fit(), [carried(partial(m.fit, train)) for m in members])
    total = " + ".join(f"part_{i} * {n}.0D" for i, n in enumerate(sizes))
    return [*fitted, SQLTransformer(statement=f"select *, ({total}) / {trees}.0D as {forest.getPredictionCol()} from __THIS__")]


def fit_predict(
    labelled: DataFrame, kind: str, features: list[str], categories: list[str] | None = None, scale: bool = True, **params
) -> tuple[PipelineModel, DataFrame]:
    """Fit every step on the training part and predict the test part.

    The assembled vectors are stored once, since training reads them many times. A boosted model also sees the validation
    part, but only to decide when to stop. Categories come as ordinal codes and as out-of-fold target means, and trees may then
    split a feature at ``CATEGORY_BINS`` places, so that a fleet of vehicles is told apart by what it does."""
    if categories and kind in ("gbt", "rf"):
        params = {"maxBins": CATEGORY_BINS, **params}
    model = regressor(kind, **params)
    check_features([*features, *(categories or [])])
    ready = filled(labelled, training_medians(train_rows(labelled), features))
    if categories:
        ready = with_target_means(ready, categories)
    prepared = preparation(features, categories, scale).fit(train_rows(ready))
    vectors = stage(prepared.transform(ready).select(
        *KEPT_WITH_VECTORS, "split", (F.col("split") == "val").alias(VALIDATION), "features"), "vectors")
    seen = vectors.where(F.col("split").isin("train", "val")) if kind == "gbt" else train_rows(vectors)
    fitted = fit_forest(model, seen) if kind == "rf" else [model.fit(seen)]
    predictions = PipelineModel(stages=fitted).transform(test_rows(vectors)).select(*PREDICTION_COLUMNS)
    return PipelineModel(stages=[*prepared.stages, *fitted]), predictions


def run_forecast(
    labelled: DataFrame, baseline: DataFrame, kind: str, features: list[str], model_name: str, **params
) -> ForecastResult:
    """The five outputs of a model run, checked against the contract."""
    _, predictions = fit_predict(labelled, kind, features, **params)
    predictions = stage(predictions, "predictions")  # five outputs read them

    def metrics(frame: DataFrame, name: str) -> DataFrame:
        return error_metrics(frame.withColumn("model_name", F.lit(name)), ["model_name"])

    result = ForecastResult(
        metrics(predictions, model_name),
        metrics(baseline, f"{model_name}_baseline"),
        predictions,
        line_hour_metrics(predictions),
        vehicle_day_metrics(predictions),
    )
    check_result(result)
    return result


def fill_means(frame: DataFrame, columns: list[str]) -> DataFrame:
    """First-round filling: mean for numbers, 'Unknown' for text, fitted on everything it is given."""
    ready = as_doubles(frame, columns)
    texts = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
    mean = Imputer(strategy="mean", inputCols=[f"x_{c}" for c in columns], outputCols=[f"filled_{c}" for c in columns])
    out = mean.fit(ready).transform(ready)
    return out.fillna("Unknown", subset=texts).drop(*[f"x_{c}" for c in columns])


def fill_medians(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Exact training medians into every part of the split."""
    return filled(labelled, training_medians(train_rows(labelled), columns))


def encode_categories(labelled: DataFrame, columns: list[str]) -> DataFrame:
    text = labelled.withColumns({f"{c}_text": F.col(c).cast("string") for c in columns})
    indexer = category_indexer([f"{c}_text" for c in columns]).fit(train_rows(text))
    out = indexer.transform(text)
    return out.withColumnsRenamed({f"{c}_text_index": f"{c}_index" for c in columns}).drop(*[f"{c}_text" for c in columns])
