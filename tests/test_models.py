"""Spark ML models: contracts, leakage guard and a band for the errors."""

import pytest

from headwise.operators import encoding as EN
from headwise.operators import models as ML
from headwise.operators.forecast import test_rows as rows_to_predict
from headwise.operators.stats import error_metrics
from headwise.plans import avl_projection as AVL
from headwise.plans import pipeline as P
from headwise.operators.gold import build_gold
from headwise.sources.staging import shared_folder, stage


@pytest.fixture(scope="module")
def features(spark, sf_dir):
    return P.labelled_features(build_gold(AVL.tables(spark, sf_dir)))


def test_forbidden_features_are_refused():
    for column in ("atraso_aproximado_min", "headway_observado_min", "y_true"):
        with pytest.raises(ValueError, match="leak"):
            ML.preparation(["hour", column])
    ML.check_features(ML.WINDOW_FEATURES + ML.LAG_FEATURES + ML.CALENDAR_FEATURES)


def test_unknown_model():
    with pytest.raises(ValueError):
        ML.regressor("oracle")


@pytest.mark.parametrize("kind, params", [("linear", {}), ("gbt", {"maxIter": 3, "maxDepth": 3}),
                                          ("rf", {"numTrees": 5, "maxDepth": 3})])
def test_run_keeps_ids_and_contract(spark, features, kind, params):
    baseline = stage(P.baseline_predictions(features, levels=1), "constant")
    result = ML.run_forecast(features, baseline, kind, ML.WINDOW_FEATURES, kind, **params)
    ids = ["event_dt", "janela_5min", "cod_linha", "cod_veiculo"]
    predicted = result.predictions.select(*ids).collect()
    assert sorted(map(tuple, predicted)) == sorted(map(tuple, rows_to_predict(features).select(*ids).collect()))
    assert result.predictions.where("y_pred is null").count() == 0
    rmse, constant = result.metrics.first()["rmse"], result.baseline_metrics.first()["rmse"]
    assert rmse < 1.5 * constant  # the fixture's delays are drawn by hash: nothing to learn, so the constant is hard to beat
    with pytest.raises(ValueError, match="lacks columns"):
        ML.check_result(result._replace(predictions=result.predictions.drop("y_true")))
    with pytest.raises(TypeError):
        ML.check_result(result._replace(metrics={}))


def test_median_filling_is_fitted_on_train_only(spark):
    rows = [("train", 1.0), ("train", 3.0), ("train", 2.0), ("train", None), ("test", None), ("test", 100.0)]
    frame = spark.createDataFrame(rows, "split string, x double")
    got = sorted((r["split"], r["filled_x"]) for r in ML.fill_medians(frame, ["x"]).collect())
    assert got == [("test", 2.0), ("test", 100.0), ("train", 1.0), ("train", 2.0), ("train", 2.0), ("train", 3.0)]


def test_unseen_category_gets_its_own_code(spark):
    frame = spark.createDataFrame([("train", "a"), ("train", "b"), ("train", "a"), ("test", "z")], "split string, c string")
    got = {r["c"]: r["c_index"] for r in ML.encode_categories(frame, ["c"]).collect()}
    assert got == {"a": 0.0, "b": 1.0, "z": 2.0}


def test_forest_takes_a_whole_fleet(spark):
    frame = spark.range(6000).selectExpr(
        "cast(id % 500 as int) cod_linha", "cast(id % 2000 as int) cod_veiculo", "if(id % 2 = 0, 'I', 'V') viagem_sentido",
        "date '2024-01-01' event_dt", "timestamp_ntz '2024-01-01 08:00:00' janela_5min", "8 faixa_horaria",
        "if(id < 4000, 'train', 'test') split", "cast(id % 500 as double) y_true", "cast(id % 7 as double) x")
    _, got = ML.fit_predict(frame, "rf", ["x"], ["cod_linha", "cod_veiculo", "viagem_sentido"], scale=False, numTrees=3)
    assert got.count() == 2000
    assert got.selectExpr("avg(abs(y_true - y_pred)) e").first()["e"] < 12.5  # a tenth of what the constant is off by


def test_forest_rows_keep_their_nodes(spark):
    assert ML.regressor("rf").getCacheNodeIds()  # without, every level sends whole trees to the tasks
    frame = spark.range(800).selectExpr(
        "date '2024-01-01' event_dt", "timestamp_ntz '2024-01-01 08:00:00' janela_5min", "cast(id as int) cod_linha",
        "cast(id % 9 as int) cod_veiculo", "8 faixa_horaria", "if(id % 4 < 3, 'train', 'test') split",
        "cast(id * 37 % 101 as double) y_true", "cast(id % 7 as double) x", "cast(id * 13 % 83 as double) z").coalesce(1)
    kept, sent = (ML.fit_predict(frame, "rf", ["x", "z"], scale=False, numTrees=3, **params)[1] for params in ({}, {"cacheNodeIds": False}))
    assert sorted((r.cod_linha, r.y_pred) for r in kept.collect()) == sorted((r.cod_linha, r.y_pred) for r in sent.collect())


def test_forest_in_parts_has_all_trees(spark):
    frame = spark.range(300).selectExpr(
        "date '2024-01-01' event_dt", "timestamp_ntz '2024-01-01 08:00:00' janela_5min", "cast(id as int) cod_linha",
        "cast(id % 9 as int) cod_veiculo", "8 faixa_horaria", "if(id % 4 < 3, 'train', 'test') split",
        "cast(id * 37 % 101 as double) y_true", "cast(id % 7 as double) x", "cast(id * 13 % 83 as double) z").coalesce(1)
    model, got = ML.fit_predict(frame, "rf", ["x", "z"], scale=False, numTrees=21, maxDepth=4)
    forests = [m for m in model.stages if hasattr(m, "trees")]
    assert len(forests) == ML.FOREST_PARTS and sum(len(m.trees) for m in forests) == 21
    assert len({m.getSeed() for m in forests}) == len({m.toDebugString.split("\n", 1)[1] for m in forests}) == ML.FOREST_PARTS
    assert {m.getFeatureSubsetStrategy() for m in forests} == {"auto"} and min(len(m.trees) for m in forests) >= 2
    rows = model.transform(ML.filled(frame, {"x": 0.0, "z": 0.0}).where("split = 'test'")).select("cod_linha", "features").collect()
    mean = {r.cod_linha: sum(t.predict(r.features) for m in forests for t in m.trees) / 21 for r in rows[:9]}
    by_line = {r.cod_linha: r.y_pred for r in got.collect()}
    assert len(by_line) == 75 and all(by_line[k] == pytest.approx(v) for k, v in mean.items())


def test_target_means_leave_out_the_own_fold(spark):
    rows = [("train", "a", 0, 1.0), ("train", "a", 1, 5.0), ("train", "a", 1, 6.0), ("train", None, 0, 3.0), ("train", None, 2, 5.0),
            ("train", "alone", 1, 100.0), ("val", "a", 1, 9.0), ("test", "a", 0, 7.0), ("test", None, 0, 7.0), ("test", "new", 0, 1.0)]
    frame = spark.createDataFrame(rows, "split string, c string, f int, y_true double")
    got = EN.with_target_means(frame, ["c"], frame["f"]).select(*frame.columns, "c_mean").collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"split", "c", "f", "y_true", "c_mean"}
    train = [r for r in rows if r[0] == "train"]
    overall = sum(r[3] for r in train) / len(train)
    for r in got:
        others = [t[3] for t in train if t[1] == r.c and (r.split != "train" or t[2] != r.f)]
        assert r.c_mean == pytest.approx((sum(others) + overall) / (len(others) + 1))
    nothing = EN.with_target_means(frame.where("split = 'test'"), ["c"], frame["f"]).collect()
    assert len(nothing) == 3 and all(r.c_mean == 0.0 for r in nothing)


def test_features_follow_the_reference_set():
    assert {"headway_referencia_min", "is_weekend"} <= set(ML.WINDOW_FEATURES)
    assert ML.regressor("gbt").getMaxIter() == 100 and ML.regressor("rf").getMaxDepth() == 30


def test_scores_ignore_missing_truth(spark, features):
    model = P.second_model(features).selectExpr("*", "'m' as model_name")
    assert error_metrics(model, ["model_name"]).first()["n_registros"] == model.where("y_true is not null").count()


def test_runs_own_their_copies_and_outputs(spark, tmp_path):
    from headwise.sources.reports import write_forecast_run
    from headwise.sources.staging import fresh_path, run_scope

    frame = spark.range(5).selectExpr("id", "'m' model_name")
    with pytest.raises(RuntimeError):
        with run_scope(spark) as folder:
            copy = stage(frame, "copy")
            assert copy.count() == 5 and folder.rsplit("/", 1)[1] in copy.inputFiles()[0]
            raise RuntimeError("a failed run")
    assert "run-" not in fresh_path(spark, "x")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
    for stamp in ("1", "2", "2"):
        write_forecast_run({"metrics": frame, "predictions": frame}, str(tmp_path), "m", stamp)
    back = spark.read.parquet(str(tmp_path / "metrics"))
    assert back.count() == 10 and {"model_name", "run"} <= set(back.columns)


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
