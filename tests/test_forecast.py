"""Medians, split, target, baselines, metrics, decisions and graph on small frames, against brute force."""

import datetime as dt
import math
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from headwise.operators import decisions as D
from headwise.operators import forecast as FC
from headwise.operators import graph as GR
from headwise.operators.stats import error_metrics, exact_median
from headwise.schemas import PREDICTION_COLUMNS
from headwise.sources import reports

T0 = dt.datetime(2024, 1, 6, 8, 0)  # a Saturday
PRED = "event_dt date, janela_5min timestamp_ntz, cod_linha int, cod_veiculo int, faixa_horaria int, y_true double, y_pred double"


def window(i):
    return T0 + dt.timedelta(minutes=5 * i)


def gold(spark, rows):
    """rows: (line, vehicle, window number, delay)"""
    data = [(window(w).date(), window(w), line, vehicle, delay) for line, vehicle, w, delay in rows]
    return spark.createDataFrame(data, "event_dt date, janela_5min timestamp_ntz, cod_linha int, cod_veiculo int, "
                                       "atraso_aproximado_min double")


def predictions(spark, rows):
    """rows: (line, vehicle, window number, truth, prediction)"""
    return spark.createDataFrame(
        [(window(w).date(), window(w), a, b, window(w).hour, t, p) for a, b, w, t, p in rows], PRED)


@pytest.mark.parametrize("accuracy", [4, 20, 10000])
def test_exact_median_whatever_the_sketch(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [("hot", rng.choice([0.0, 0.0, rng.expovariate(1)])) for _ in range(3000)]
    rows += [(f"g{i % 7}", float(rng.randrange(5))) for i in range(100)]
    rows += [("one", 3.5), ("even", 1.0), ("even", 2.0), ("hot", None), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, x double").repartition(6)
    groups = defaultdict(list)
    for k, x in rows:
        if x is not None:
            groups[k].append(x)
    got = {r["k"]: r["m"] for r in exact_median(frame, "x", ["k"], "m", accuracy).collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}
    everything = [x for _, x in rows if x is not None]
    assert exact_median(frame, "x", [], "m", accuracy).first()["m"] == statistics.median(everything)


def test_target_order_of_dropping(spark):
    frame = gold(spark, [(1, 1, 0, 1.0), (1, 1, 1, None), (1, 1, 2, 3.0), (1, 2, 0, 9.0)])
    labelled = {r["janela_5min"]: r["y_true"] for r in FC.target_next_window(frame).collect()}
    assert labelled == {window(0): 3.0}
    rows = {r["janela_5min"]: r["y_true"] for r in FC.target_next_window(frame, drop_null_first=False).collect()}
    assert rows == {window(1): 3.0}


def test_lags_and_rolling(spark):
    frame = gold(spark, [(1, 1, w, float(w)) for w in range(5)] + [(1, 2, 2, 10.0)])
    lag = {(r["cod_veiculo"], r["janela_5min"]): r["lag_1_atraso_aproximado_min"]
           for r in FC.lag_features(frame, ["atraso_aproximado_min"]).collect()}
    assert lag[1, window(0)] is None and lag[1, window(3)] == 2.0 and lag[2, window(2)] is None
    roll = {(r["cod_veiculo"], r["janela_5min"]): r
            for r in FC.rolling_features(frame, ["atraso_aproximado_min"], 2).collect()}
    assert len(roll) == 6
    assert roll[1, window(4)]["roll_2_vehicle_atraso_aproximado_min"] == 2.5
    # line means per window: 0, 1, (2 + 10) / 2, 3
    assert roll[1, window(4)]["roll_2_line_atraso_aproximado_min"] == 4.5
    assert roll[2, window(2)]["roll_2_line_atraso_aproximado_min"] == 0.5


def test_weekday_starts_on_monday(spark):
    row = FC.temporal_features(gold(spark, [(1, 1, 0, 0.0)])).first()
    assert (row["hour"], row["minute"], row["day_of_week"], row["is_weekend"]) == (8, 0, 5, True)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 371])
def test_split_equals_sorted_positions(spark, n):
    rng = random.Random(n)
    # a third of all rows in one window and many on one line
    keys = set()
    while len(keys) < n:
        w = 17 if rng.random() < 0.34 else rng.randrange(40)
        keys.add((w, 1 if rng.random() < 0.6 else rng.randrange(9), rng.randrange(60)))
    frame = gold(spark, [(line, vehicle, w, 0.0) for w, line, vehicle in keys]).withColumn("y_true", F.lit(0.0))
    got = {(r["janela_5min"], r["cod_linha"], r["cod_veiculo"]): r["split"] for r in FC.temporal_split(frame).collect()}
    first, second = math.floor(n * 0.70), math.floor(n * 0.85)
    for i, (w, line, vehicle) in enumerate(sorted(keys)):
        assert got[window(w), line, vehicle] == ("train" if i < first else "val" if i < second else "test")
    sizes = FC.split_sizes(FC.temporal_split(frame)).first()
    assert tuple(sizes) == (n, first, second - first, n - second)


def test_split_of_nothing(spark):
    assert FC.temporal_split(gold(spark, [(1, 1, 0, 0.0)]).where("false")).count() == 0


def test_split_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    gold(spark, [(1, v, w, 0.0) for v in range(5) for w in range(20)]).write.parquet(path)
    stored = spark.read.parquet(path)
    bound = FC.split_bounds(stored)[0]
    plan = stored.where(FC.before(bound))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(janela_5min" in plan
    assert stored.where(FC.before(bound)).count() == 70


def test_baseline_levels_and_fallbacks(spark):
    train = predictions(spark, [(1, 1, 0, 1.0, None), (1, 1, 1, 3.0, None), (1, 1, 12, 10.0, None), (2, 1, 0, 50.0, None)])
    test = predictions(spark, [(1, 1, 2, 0.0, None), (1, 1, 24, 0.0, None), (9, 1, 0, 0.0, None)])
    fitted = FC.fit_baseline(train)
    rows = test.drop("y_pred")

    def answer(levels):
        found = FC.baseline_predict(rows, fitted, levels).collect()
        return {(r["cod_linha"], r["faixa_horaria"]): r["y_pred"] for r in found}

    assert answer(3) == {(1, 8): 2.0, (1, 10): 3.0, (9, 8): 6.5}
    assert answer(2) == {(1, 8): 2.0, (1, 10): 6.5, (9, 8): 6.5}
    assert answer(1) == {(1, 8): 6.5, (1, 10): 6.5, (9, 8): 6.5}


def test_metrics_of_zero_truth(spark):
    rows = predictions(spark, [(1, 1, 0, 0.0, 2.0), (1, 1, 1, 0.0, 1.0), (1, 1, 2, None, 1.0)]).withColumn("m", F.lit("x"))
    got = error_metrics(rows, ["m"]).first()
    assert (got["n_registros"], got["mae"], got["wape"], got["medae"], got["mape_secondary"]) == (2, 1.5, 0.0, 1.5, 150.0)
    assert got["rmse"] == pytest.approx(math.sqrt(2.5))


def test_audit_of_a_model_without_valid_rows(spark):
    rows = predictions(spark, [(1, 1, 0, None, 2.0), (1, 1, 1, 1.0, None)]).withColumn("model_name", F.lit("x"))
    got = FC.prediction_audit(rows).first()
    assert (got["rows_total"], got["rows_valid"], got["null_y_true"], got["status"], got["mae"]) == (
        2, 0, 1, "invalid_predictions", None)


def test_hour_column_and_required_columns(spark):
    rows = predictions(spark, [(1, 1, 0, 1.0, 2.0), (1, None, 0, 1.0, 2.0)])
    assert D.ensure_hour(rows).columns.count("hour") == 1
    assert D.ensure_hour(rows.drop("faixa_horaria")).first()["hour"] == 8
    both = D.ensure_hour(rows.withColumn("hour", F.lit(99)))
    assert both.columns.count("hour") == 1 and "faixa_horaria" not in both.columns and both.first()["hour"] != 99
    with pytest.raises(ValueError):
        D.ensure_hour(rows.select("cod_linha"))
    with pytest.raises(ValueError, match="lack columns"):
        D.clean_predictions(rows.drop("y_pred"))
    assert D.clean_predictions(rows).count() == 1
    assert tuple(D.dropped_predictions(rows).first()) == (2, 1)


def aggregates(spark):
    rng = random.Random(3)
    rows = [(line, vehicle, w, rng.random(), rng.random()) for line in range(3) for vehicle in range(4) for w in range(30)]
    frame = predictions(spark, rows)
    return D.decision_aggregates(frame, frame, "m", 1, 1, 1, 1)


def test_rank_ties_follow_the_key(spark):
    rows = predictions(spark, [(line, 1, 0, 1.0, 1.0) for line in (5, 3, 4)])
    ranked = D.line_ranking(D.clean_predictions(rows), "m", 1).collect()
    assert [(r["rank"], r["cod_linha"]) for r in ranked] == [(1, 3), (2, 4), (3, 5)]
    assert D.line_ranking(D.clean_predictions(rows), "m", 2).count() == 0


def test_package_and_manifest(spark, tmp_path):
    sets = {k: v for k, v in aggregates(spark).items() if k in ("line_ranking", "hour_ranking")}
    paths = reports.write_package(sets, str(tmp_path), "r1")
    manifest = {r["dataset_name"]: r for r in reports.package_manifest(sets, "r1").collect()}
    assert manifest["line_ranking"]["row_count"] == 3 and manifest["hour_ranking"]["file_name"] == "hour_ranking_r1.csv"
    back = reports.read_csv(spark, paths["line_ranking"], sets["line_ranking"].schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sets["line_ranking"].collect()))


def test_csv_nan_becomes_null(spark, tmp_path):
    frame = spark.createDataFrame([(1, float("nan")), (2, 1.5), (3, None)], "i int, x double")
    path = reports.write_csv(frame, str(tmp_path / "c"))
    back = reports.read_csv(spark, path, "i int, x double")
    assert {r["i"]: r["x"] for r in back.collect()} == {1: None, 2: 1.5, 3: None}


def test_graph_identity_purge_and_upsert(spark):
    sets = aggregates(spark)
    graph = GR.decision_graph(spark, sets, "r", stage="final")
    assert GR.unique_violations(graph.nodes).where("violations > 0").count() == 0
    counts = {r["label"]: r["nodes"] for r in GR.unique_violations(graph.nodes).collect()}
    assert counts["Linha"] == 3 and counts["Veiculo"] == 4 and counts["DecisionAggregateRun"] == 1
    assert counts["CriticalSegment"] == sets["segment_error"].count()
    again = GR.upsert(graph, graph)
    assert again.nodes.count() == graph.nodes.count() and again.edges.count() == graph.edges.count()
    left = GR.purge(graph)
    assert {r["label"] for r in left.nodes.select("label").distinct().collect()} == {"Linha", "Veiculo"}
    assert left.edges.count() == 0
    assert GR.purge(graph, []).nodes.count() == graph.nodes.count()  # no label named, nothing removed
    assert GR.purge(graph, ["Linha"]).nodes.where("label = 'Linha'").count() == 0
    # an edge end is always a node
    ids = graph.nodes.select("label", "id")
    for side in ("src", "dst"):
        ends = graph.edges.select(F.col(f"{side}_label").alias("label"), F.col(f"{side}_id").alias("id"))
        assert ends.join(ids, ["label", "id"], "left_anti").count() == 0


def test_upsert_keeps_what_the_new_run_does_not_set(spark):
    old = GR.Graph(spark.createDataFrame([("Linha", "1", 1, "a"), ("Linha", "2", 2, "a")],
                                         "label string, id string, latest_line_rank int, note string"),
                   spark.createDataFrame([], "type string, src_label string, src_id string, dst_label string, dst_id string"))
    new = GR.Graph(spark.createDataFrame([("Linha", "2", 7), ("Linha", "3", 8)],
                                         "label string, id string, latest_line_rank int"), old.edges)
    got = {r["id"]: (r["latest_line_rank"], r["note"]) for r in GR.upsert(old, new).nodes.collect()}
    assert got == {"1": (1, "a"), "2": (7, "a"), "3": (8, None)}


def test_duplicate_ids_are_reported(spark):
    nodes = spark.createDataFrame([("Linha", "1"), ("Linha", "1"), ("Linha", "2")], "label string, id string")
    assert tuple(GR.unique_violations(nodes).first()) == ("Linha", 3, 2, 1)


def test_prediction_columns_are_the_contract(spark):
    assert predictions(spark, [(1, 1, 0, 1.0, 2.0)]).columns == PREDICTION_COLUMNS
