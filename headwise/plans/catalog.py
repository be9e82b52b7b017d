"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query starts from the whole ``events`` table, runs the operators a user would run, and rounds doubles to nine digits
for comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.functions import rules
from headwise.functions.clock import window_start
from headwise.functions.frames import rounded
from headwise.operators import decisions as D
from headwise.operators import encoding as EN
from headwise.operators import forecast as FC
from headwise.operators import gold as G
from headwise.operators import graph as GR
from headwise.operators import headway as H
from headwise.operators import messages as M
from headwise.operators import models as ML
from headwise.operators import quality as Q
from headwise.operators import semantic as S
from headwise.operators import silver as SV
from headwise.operators import stats
from headwise.plans import avl_projection as AVL
from headwise.plans import pipeline as P
from headwise.schemas import SILVER_COLUMNS
from headwise.sources import lake, reports, versions
from headwise.sources.staging import fresh_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ["event_dt", "janela_5min", "cod_linha", "cod_veiculo"]
RUN = "run_model"
SUPPORT = {"min_line": 3, "min_line_hour": 2, "min_segment": 1, "min_vehicle": 3}
BASELINE_NAME = "baseline_median_future_by_line_timeband"


def query(function: Query) -> Query:
    """Register a query under its own name."""
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(function(spark, sf_dir))

    QUERIES[function.__name__] = run
    return run


# --- shared steps -----------------------------------------------------------------------------------------------------
def _gold(spark, sf):
    return G.build_gold(AVL.gold_inputs(spark, sf))


def _labelled(spark, sf):
    # the target is the only reader of Gold here, so Gold itself is not written
    return P.labelled_windows(_gold(spark, sf))


def _predictions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(model, baseline) on the test part, both written once."""
    labelled = _labelled(spark, sf)
    return P.second_model(labelled), stage(P.baseline_predictions(labelled), "baseline")


def _model(spark, sf) -> DataFrame:
    return P.second_model(_labelled(spark, sf))  # a narrow projection of a stored table


def _aggregates(spark, sf, compared: bool = True) -> dict[str, DataFrame]:
    model, baseline = _predictions(spark, sf) if compared else (_model(spark, sf), None)
    return D.decision_aggregates(model, baseline, "model", **SUPPORT)


def _graph(spark, sf, *parts: str) -> GR.Graph:
    """The graph of the model run, or the parts a question needs."""
    parts = parts or tuple(GR.PARTS)
    return GR.decision_graph(spark, _aggregates(spark, sf, "line_hours" in parts), RUN, parts, stage="final")


def _tagged(spark, sf):
    return SV.tag_tables(AVL.points(spark, sf))


def _tagged_with_copies(spark, sf):
    """Tagged rows with every message whose number leaves 1 modulo 500 doubled: a feed with duplicates."""
    twice = F.when(F.col("event_id").cast("bigint") % 500 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    points = AVL.points(spark, sf).withColumn("copy", F.explode(twice)).drop("copy")
    return SV.tag_tables(points)


# --- sources and sinks ------------------------------------------------------------------------------------------------
@query
def bronze_json_scan(spark, sf):
    """Messages written as JSON Lines and read back with the declared schema."""
    path = fresh_path(spark, "bronze")
    messages = AVL.bronze_messages(spark, sf)
    messages.select(F.to_json(F.struct(*messages.columns)).alias("value")).write.text(path)
    return SV.silver_table(M.message_points(lake.read_bronze(spark, path)), "gps_events")


def _written_silver(spark, sf) -> tuple[str, DataFrame]:
    base = fresh_path(spark, "silver")
    table = SV.silver_table(AVL.points(spark, sf), "gps_events")
    lake.write_silver(table, base, "gps_events")
    return f"{base}/gps_events", table


@query
def silver_scan_pruned(spark, sf):
    path, table = _written_silver(spark, sf)
    return lake.between_days(lake.read_partitioned(spark, path, table.schema), "2024-01-02", "2024-01-02")


@query
def silver_write_readback(spark, sf):
    path, table = _written_silver(spark, sf)
    return lake.read_partitioned(spark, path, table.schema)


@query
def silver_reingest(spark, sf):
    """A day written again with another company, and another message type for half of its rows: nothing old is left."""
    base = fresh_path(spark, "silver")
    table = stage(SV.silver_table(AVL.points(spark, sf), "stop_events"), "stop-events")
    lake.write_silver(table, base, "stop_events")
    even = F.col("event_id").cast("bigint") % 2 == 0
    corrected = lake.between_days(table, "2024-01-02", "2024-01-02").withColumns({
        "id_empresa": F.lit(99), "tipo_mensagem": F.when(even, F.lit("AVL_EVT_CORRIGIDO")).otherwise(F.col("tipo_mensagem"))})
    path = lake.write_silver(stage(corrected, "stop-events-corrected"), base, "stop_events")
    return lake.read_partitioned(spark, path, table.schema).select(
        "event_id", "gps_idx", "event_dt", "tipo_mensagem", "id_empresa")


#: message types that need escaping in a folder name
ODD_KINDS = ["A:B", "x y/z", "A=B", "100%", "n\u00e3o"]


def _swapped_silver(spark, sf) -> str:
    """Versioned days with odd message types and without a day; then one day is corrected and another loses all its rows."""
    base, number = fresh_path(spark, "silver-days"), F.col("event_id").cast("bigint")
    odd = F.when(number % 8 == 5, F.lit(None))
    for k, kind in enumerate(ODD_KINDS):
        odd = odd.when(number % 8 == k, F.lit(kind))
    table = stage(SV.silver_table(AVL.points(spark, sf), "stop_events").withColumns({
        "tipo_mensagem": odd.otherwise(F.col("tipo_mensagem")), "event_dt": F.when(number % 11 != 0, F.col("event_dt"))}), "stop-events")
    lake.swap_silver(table, base, "stop_events")
    corrected = lake.between_days(table, "2024-01-02", "2024-01-02").where(number % 3 != 0).withColumn("id_empresa", F.lit(99))
    lake.swap_silver(corrected, base, "stop_events", days=["2024-01-02", "2024-01-03"])
    return base


@query
def silver_day_swap(spark, sf):
    return versions.read_days(spark, f"{_swapped_silver(spark, sf)}/stop_events").select(
        "event_id", "gps_idx", "event_dt", "tipo_mensagem", "id_empresa")


@query
def silver_stored_days(spark, sf):
    return SV.stored_silver_days(spark, _swapped_silver(spark, sf), "stop_events")


def _written_gold(spark, sf) -> str:
    return lake.write_gold(_gold(spark, sf), fresh_path(spark, "final_table"))


@query
def gold_write_readback(spark, sf):
    return lake.read_gold(spark, _written_gold(spark, sf))


@query
def gold_scan_subset(spark, sf):
    return lake.read_gold(spark, _written_gold(spark, sf), P.FORECAST_COLUMNS)


@query
def csv_roundtrip(spark, sf):
    model = _model(spark, sf)
    path = reports.write_csv(model, fresh_path(spark, "csv"))
    return reports.read_csv(spark, path, model.schema)


@query
def dq_report_union(spark, sf):
    tagged = _tagged_with_copies(spark, sf)
    b = Q.dq_coordinates(tagged).select(
        "table_name", "rows_total", "event_dt_min", "event_dt_max", "coords_null_rows", "invalid_coord_pair_rows", "status"
    )
    return reports.union_reports([Q.dq_duplicates(tagged), b])


@query
def metrics_table(spark, sf):
    labelled = _labelled(spark, sf)
    fitted = P.fitted_baseline(labelled)
    predicted = stage(FC.baseline_predict(FC.test_rows(labelled), fitted), "baseline")
    return FC.metrics_table(labelled, fitted, predicted, BASELINE_NAME)


@query
def package_manifest(spark, sf):
    return reports.package_manifest(_aggregates(spark, sf), RUN)


# --- projections ------------------------------------------------------------------------------------------------------
@query
def flatten_header(spark, sf):
    return AVL.flat_messages(spark, sf).withColumn("n_gps", F.size("gps_array")).drop("gps_array")


@query
def explode_gps(spark, sf):
    point = F.col("gps_point")
    return M.explode_gps(AVL.flat_messages(spark, sf)).select(
        "event_id", "tipo_mensagem", "gps_idx", point["timestampUtcGeracao"].alias("gps_timestamp_utc_geracao"),
        point["sinalGps"].alias("gps_sinal"), point["latitude"].alias("latitude_raw"),
        point["longitude"].alias("longitude_raw"),
    )


@query
def normalize_time(spark, sf):
    return M.normalize_time(M.explode_gps(AVL.flat_messages(spark, sf))).select(
        "event_id", "gps_idx", "event_ts", "event_dt", "created_at_origem", "created_at_ingestao"
    )


@query
def normalize_coords(spark, sf):
    return M.normalize_points(M.explode_gps(AVL.flat_messages(spark, sf))).select(
        "event_id", "gps_idx", *M.POINT_FIELDS, "latitude", "longitude"
    )


@query
def silver_gps_events(spark, sf):
    return SV.silver_table(AVL.parsed_points(spark, sf), "gps_events")


@query
def silver_stop_events(spark, sf):
    return SV.silver_table(AVL.parsed_points(spark, sf), "stop_events")


@query
def silver_fare_events(spark, sf):
    return SV.silver_table(AVL.parsed_points(spark, sf), "fare_events")


@query
def silver_operational_events(spark, sf):
    return SV.silver_table(AVL.parsed_points(spark, sf), "operational_events")


@query
def preview(spark, sf):
    return SV.preview(AVL.points(spark, sf), 10)


@query
def semantic_fallbacks(spark, sf):
    return rules.with_fallback_keys(AVL.points(spark, sf)).select(
        "event_id", "gps_idx", "id_empresa", "cod_linha", "cod_veiculo", "viagem_sentido", "cod_tabela_programacao"
    )


@query
def canonical_timestamp(spark, sf):
    """Some event times and device times are blanked so that every fallback is used."""
    number = F.col("event_id").cast("bigint")
    points = AVL.points(spark, sf).withColumns({
        "event_ts": F.when(number % 13 != 0, F.col("event_ts")),
        "created_at_origem": F.when(number % 26 != 0, F.col("created_at_origem")),
    })
    return points.select("event_id", "gps_idx", rules.canonical_timestamp().alias("canonical_ts"))


@query
def bucket_5min(spark, sf):
    return AVL.points(spark, sf).select("event_id", "gps_idx", window_start(F.col("event_ts")).alias("janela_5min"))


@query
def gps_invalid_flag(spark, sf):
    return AVL.points(spark, sf).select(
        "event_id", "gps_idx", "gps_sinal", "latitude", "longitude", rules.gps_is_invalid().alias("gps_is_invalid")
    )


@query
def contract_table(spark, sf):
    return G.contract_table(AVL.tables(spark, sf))


@query
def ensure_hour(spark, sf):
    return D.ensure_hour(_gold(spark, sf).select("cod_linha", "cod_veiculo", "janela_5min", "atraso_aproximado_min"))


# --- filters and samples ----------------------------------------------------------------------------------------------
@query
def date_range_filter(spark, sf):
    return lake.between_days(SV.silver_table(AVL.points(spark, sf), "gps_events"), first="2024-01-02")


@query
def clean_predictions(spark, sf):
    return D.clean_predictions(_model(spark, sf))


@query
def dropped_predictions(spark, sf):
    return D.dropped_predictions(_model(spark, sf))


@query
def sample_fraction(spark, sf):
    return SV.sample_rows(SV.silver_table(AVL.points(spark, sf), "gps_events"), 0.25)


@query
def limit_records(spark, sf):
    return SV.limit_rows(SV.silver_table(AVL.points(spark, sf), "gps_events"), 100)


# --- joins and Gold ---------------------------------------------------------------------------------------------------
@query
def headway_delay(spark, sf):
    return H.headway_delay(SV.silver_table(AVL.points(spark, sf), "stop_events"))


@query
def gold_semi_keys(spark, sf):
    tables = AVL.tables(spark, sf)
    return G.limited_to_contract(G.stop_vehicle_windows(tables["stop_events"]), G.contract_table(tables))


@query
def gold_vehicle_join(spark, sf):
    tables = AVL.gold_inputs(spark, sf)
    return G.stop_windows_with_context(
        G.stop_vehicle_windows(tables["stop_events"]), G.vehicle_window_context(tables["gps_events"])
    )


@query
def gold_final_table(spark, sf):
    return G.materialize_gold(AVL.gold_inputs(spark, sf))


@query
def gold_custom_contract(spark, sf):
    """Gold limited to the windows of a user's transform, with a reference headway that knows the first day only."""
    def first_half_hours(tables):
        return G.contract_table(tables).where(F.minute("janela_5min") < 30)

    return G.materialize_gold(AVL.tables(spark, sf), first_half_hours, fit_until="2024-01-01")


@query
def event_alignment(spark, sf):
    return G.align_events(AVL.tables(spark, sf))


@query
def union_events(spark, sf):
    return G.union_events(AVL.tables(spark, sf))


@query
def vehicle_window_context(spark, sf):
    return G.vehicle_window_context(SV.silver_table(AVL.points(spark, sf), "gps_events"))


@query
def stop_vehicle_windows(spark, sf):
    return G.stop_vehicle_windows(SV.silver_table(AVL.points(spark, sf), "stop_events"))


@query
def headway_gaps(spark, sf):
    return H.headway_gaps(SV.silver_table(AVL.points(spark, sf), "stop_events"))


@query
def headway_gap_rows(spark, sf):
    return H.headway_gap_rows(SV.silver_table(AVL.points(spark, sf), "stop_events"))


@query
def headway_observed(spark, sf):
    return H.headway_observed(SV.silver_table(AVL.points(spark, sf), "stop_events"))


@query
def headway_reference(spark, sf):
    return H.headway_reference(H.headway_observed(SV.silver_table(AVL.points(spark, sf), "stop_events")))


@query
def gold_validation(spark, sf):
    return G.gold_validation(_gold(spark, sf))


@query
def contract_validation(spark, sf):
    return G.contract_report(G.contract_table(AVL.tables(spark, sf)))


# --- quality ----------------------------------------------------------------------------------------------------------
@query
def silver_validation(spark, sf):
    return SV.validate_tagged(_tagged(spark, sf))


@query
def silver_days(spark, sf):
    return SV.silver_days(SV.silver_table(AVL.points(spark, sf), "gps_events"))


@query
def dq_duplicates(spark, sf):
    return Q.dq_duplicates(_tagged_with_copies(spark, sf))


@query
def dq_duplicates_by_day(spark, sf):
    return Q.dq_duplicates_by_day(_tagged_with_copies(spark, sf))


@query
def dq_coordinates(spark, sf):
    return Q.dq_coordinates(_tagged_with_copies(spark, sf))


@query
def dq_nulls_types(spark, sf):
    return Q.dq_nulls_types(_tagged_with_copies(spark, sf))


@query
def dq_summary(spark, sf):
    return Q.dq_summary(_tagged_with_copies(spark, sf))


@query
def raw_profile(spark, sf):
    return Q.raw_profile(AVL.flat_messages(spark, sf))


@query
def bronze_corrupt_lines(spark, sf):
    """JSON Lines in which some lines are cut off."""
    path = fresh_path(spark, "bronze")
    messages = AVL.bronze_messages(spark, sf).select(F.col("_id")["$oid"].cast("bigint").alias("id"), F.to_json(F.struct("*")).alias("line"))
    broken = F.when(F.col("id") % 400 == 3, F.expr("substring(line, 1, length(line) - 5)")).otherwise(F.col("line"))
    messages.select(broken.alias("value")).write.text(path)
    return Q.corrupt_lines(lake.read_bronze(spark, path))


@query
def raw_profile_by_type(spark, sf):
    return Q.raw_profile_by_type(AVL.flat_messages(spark, sf))


# --- target, features, baselines --------------------------------------------------------------------------------------
@query
def target_next_window(spark, sf):
    return FC.target_next_window(_gold(spark, sf).select(*P.FORECAST_COLUMNS))


@query
def target_next_row(spark, sf):
    return FC.target_next_window(_gold(spark, sf).select(*P.FORECAST_COLUMNS), drop_null_first=False)


@query
def lag_features(spark, sf):
    return FC.lag_features(_gold(spark, sf)).select(*KEY, *[f"lag_1_{c}" for c in FC.LAGGED])


@query
def rolling_features(spark, sf):
    columns = ["velocidade_media", "atraso_aproximado_min"]
    gold = P.stored_gold(AVL.gold_inputs(spark, sf)).select(*KEY, *columns)
    return FC.rolling_features(gold, columns).drop(*columns)


@query
def temporal_features(spark, sf):
    return FC.temporal_features(_gold(spark, sf)).select(*KEY, "hour", "minute", "day_of_week", "is_weekend")


@query
def temporal_split(spark, sf):
    return _labelled(spark, sf).select(*KEY, "y_true", "split")


@query
def split_sizes(spark, sf):
    return FC.split_sizes(_labelled(spark, sf))


@query
def baseline_predict(spark, sf):
    return P.baseline_predictions(_labelled(spark, sf))


@query
def baseline_two_level(spark, sf):
    return P.baseline_predictions(_labelled(spark, sf), levels=2)


@query
def baseline_global(spark, sf):
    return P.baseline_predictions(_labelled(spark, sf), levels=1)


@query
def baseline_contemporaneous(spark, sf):
    return FC.baseline_contemporaneous(P.stored_gold(AVL.gold_inputs(spark, sf)).select(*P.FORECAST_COLUMNS))


@query
def predictions(spark, sf):
    return P.baseline_predictions(_labelled(spark, sf)).select(F.lit(BASELINE_NAME).alias("model_name"), "*")


@query
def error_metrics(spark, sf):
    model, baseline = _predictions(spark, sf)
    return stats.error_metrics(_both(model, baseline), ["model_name"])


def _both(model, baseline):
    return model.withColumn("model_name", F.lit("model")).unionByName(baseline.withColumn("model_name", F.lit("baseline")))


@query
def prediction_audit(spark, sf):
    model, baseline = _predictions(spark, sf)
    return FC.prediction_audit(_both(model, baseline))


@query
def model_comparison(spark, sf):
    labelled = _labelled(spark, sf)
    fitted, test = P.fitted_baseline(labelled), FC.test_rows(labelled)
    three, one = (stage(FC.baseline_predict(test, fitted, levels), "predicted") for levels in (3, 1))
    return FC.model_comparison(three, one, "baseline_three_level", "constant_median")


@query
def target_zero_mass(spark, sf):
    return FC.target_zero_mass(FC.test_rows(_labelled(spark, sf)))


@query
def line_hour_metrics(spark, sf):
    return FC.line_hour_metrics(P.baseline_predictions(_labelled(spark, sf)))


@query
def line_datehour_metrics(spark, sf):
    return FC.line_datehour_metrics(P.baseline_predictions(_labelled(spark, sf)))


@query
def vehicle_day_metrics(spark, sf):
    return FC.vehicle_day_metrics(P.baseline_predictions(_labelled(spark, sf)))


@query
def actual_delay_means(spark, sf):
    return FC.actual_delay_means(P.stored_gold(AVL.gold_inputs(spark, sf)).select(*P.FORECAST_COLUMNS))


# --- models -----------------------------------------------------------------------------------------------------------
def _features(spark, sf):
    return P.labelled_features(_gold(spark, sf))


@query
def impute_median(spark, sf):
    filled = ML.fill_medians(_features(spark, sf), ML.LAG_FEATURES)
    return filled.select(*KEY, "split", *[f"filled_{c}" for c in ML.LAG_FEATURES])


@query
def impute_mean(spark, sf):
    columns = ["velocidade_media", "latitude_media", "headway_observado_min", "atraso_aproximado_min"]
    filled = ML.fill_means(P.stored_gold(AVL.gold_inputs(spark, sf)), columns)
    return filled.select(*KEY, "viagem_sentido", *[f"filled_{c}" for c in columns])


@query
def encode_categories(spark, sf):
    return ML.encode_categories(_features(spark, sf), ["cod_linha", "viagem_sentido"]).select(
        *KEY, "viagem_sentido", "cod_linha_index", "viagem_sentido_index"
    )


@query
def target_mean_codes(spark, sf):
    """Out-of-fold means of the target by line and vehicle; the folds come from clock and vehicle, so that SQL can follow."""
    fold = (F.hour("janela_5min") * 12 + F.floor(F.minute("janela_5min") / 5) + F.col("cod_veiculo")) % 5
    return EN.with_target_means(_labelled(spark, sf), ["cod_linha", "cod_veiculo"], fold).select(
        *KEY, "split", "cod_linha_mean", "cod_veiculo_mean")


@query
def gbt_forecast(spark, sf):
    return ML.fit_predict(_features(spark, sf), "gbt", ML.WINDOW_FEATURES + ML.LAG_FEATURES)[1]


@query
def rf_forecast(spark, sf):
    codes = ["cod_linha", "cod_veiculo", "viagem_sentido"]
    return ML.fit_predict(_features(spark, sf), "rf", ML.WINDOW_FEATURES, codes, scale=False)[1]


@query
def linear_forecast(spark, sf):
    return ML.fit_predict(_features(spark, sf), "linear", ML.CALENDAR_FEATURES)[1]


@query
def linear_two_features(spark, sf):
    """A fitted model whose solution SQL can give as well: least squares on hour and minute."""
    return _fitted_line(spark, sf).withColumn("y_pred", F.round("y_pred", 6))


def _fitted_line(spark, sf) -> DataFrame:
    return ML.fit_predict(_features(spark, sf), "linear", ["hour", "minute"], solver="normal")[1]


@query
def fitted_line_ranking(spark, sf):
    """The fitted model carried through to a decision table."""
    ranking = D.line_ranking(D.clean_predictions(_fitted_line(spark, sf)), "linear", 10)
    return ranking.drop("rank").withColumn(D.PRED, F.round(D.PRED, 6))


def _boosted_aggregates(spark, sf) -> dict[str, DataFrame]:
    """A boosted model through the whole run and all decision tables, at the published supports."""
    features = stage(_features(spark, sf), "features")
    baseline = stage(P.baseline_predictions(features), "baseline")
    run = ML.run_forecast(features, baseline, "gbt", ML.WINDOW_FEATURES + ML.LAG_FEATURES, "gbt")
    return D.decision_aggregates(run.predictions, baseline, "gbt", min_line=10, min_line_hour=5, min_segment=5, min_vehicle=10)


@query
def boosted_decisions(spark, sf):
    """Keys, supports and true means of every decision table of the boosted model: what does not depend on its numbers."""
    sets = _boosted_aggregates(spark, sf)
    keys = {"line_hour_final": ["cod_linha", "hour"], "line_ranking": ["cod_linha"], "hour_ranking": ["hour"],
            "segment_error": ["cod_linha", "hour", "cod_veiculo"], "vehicle_instability": ["cod_veiculo"],
            "line_hour_compare": ["cod_linha", "hour"]}
    frames = [sets[name].select(
        F.lit(name).alias("data_set"), F.concat_ws("|", *columns).alias("key"), F.col(D.REAL).alias(D.REAL), F.col(D.N).alias(D.N))
        for name, columns in keys.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


@query
def boosted_graph_edges(spark, sf):
    """The edges of the decision graph of the boosted model, after merging it into an older graph that holds half of them."""
    graph = GR.decision_graph(spark, _boosted_aggregates(spark, sf), RUN, tuple(GR.PARTS), stage="final")
    edges = ["type", "src_label", "src_id", "dst_label", "dst_id"]
    old = GR.Graph(graph.nodes, graph.edges.where(F.crc32(F.col("dst_id").cast("binary")) % 2 == 0))
    return GR.upsert(old, graph).edges.select(*edges)


@query
def model_keys(spark, sf):
    """Rows that each kind of model predicts, by kind; short fits, as only the keys are compared."""
    features = _features(spark, sf)
    sizes = {"linear": {}, "gbt": {"maxIter": 2}, "rf": {"numTrees": 2, "maxDepth": 4}}
    frames = [ML.fit_predict(features, kind, ML.WINDOW_FEATURES, **size)[1].select(F.lit(kind).alias("kind"), *KEY, "y_true")
              for kind, size in sizes.items()]
    return frames[0].union(frames[1]).union(frames[2])


# --- decisions --------------------------------------------------------------------------------------------------------
@query
def pred_line_hour(spark, sf):
    return D.pred_line_hour(D.clean_predictions(_model(spark, sf)), "model", SUPPORT["min_line_hour"])


@query
def line_ranking(spark, sf):
    return D.line_ranking(D.clean_predictions(_model(spark, sf)), "model", SUPPORT["min_line"])


@query
def hour_ranking(spark, sf):
    return D.hour_ranking(D.clean_predictions(_model(spark, sf)), "model", SUPPORT["min_line_hour"])


@query
def segment_errors(spark, sf):
    return D.segment_errors(D.clean_predictions(_model(spark, sf)), "model", SUPPORT["min_segment"])


@query
def vehicle_instability(spark, sf):
    days = FC.vehicle_day_metrics(D.clean_predictions(_model(spark, sf)))
    return D.vehicle_instability(days, "model", SUPPORT["min_vehicle"])


@query
def line_hour_compare(spark, sf):
    return _aggregates(spark, sf)["line_hour_compare"]


@query
def top_summary(spark, sf):
    return D.top_summary(_aggregates(spark, sf, False))


@query
def top_compare(spark, sf):
    model, baseline = _predictions(spark, sf)
    old = D.decision_aggregates(baseline, None, "baseline", **SUPPORT)
    new = D.decision_aggregates(model, None, "model", **SUPPORT)
    return D.top_compare(D.top_summary(old), D.top_summary(new))


# --- graph ------------------------------------------------------------------------------------------------------------
@query
def graph_rank_line(spark, sf):
    return GR.line_rank_graph(_aggregates(spark, sf, False)["line_ranking"], RUN).edges


@query
def graph_rank_line_nodes(spark, sf):
    return GR.line_rank_graph(_aggregates(spark, sf, False)["line_ranking"], RUN).nodes


@query
def graph_rank_hour(spark, sf):
    return GR.hour_rank_graph(_aggregates(spark, sf, False)["hour_ranking"], RUN).edges


@query
def graph_rank_hour_nodes(spark, sf):
    return GR.hour_rank_graph(_aggregates(spark, sf, False)["hour_ranking"], RUN).nodes


@query
def graph_rank_vehicle(spark, sf):
    return GR.vehicle_rank_graph(_aggregates(spark, sf, False)["vehicle_instability"], RUN).edges


@query
def graph_rank_vehicle_nodes(spark, sf):
    return GR.vehicle_rank_graph(_aggregates(spark, sf, False)["vehicle_instability"], RUN).nodes


@query
def graph_line_hour(spark, sf):
    return GR.line_hour_graph(_aggregates(spark, sf)["line_hour_compare"], RUN).edges


@query
def graph_line_hour_nodes(spark, sf):
    nodes = GR.line_hour_graph(_aggregates(spark, sf)["line_hour_compare"], RUN).nodes
    return nodes.where(F.col("label") == GR.METRIC).drop("code", "hour", "hour_label")


@query
def graph_segments(spark, sf):
    return GR.segment_graph(_aggregates(spark, sf, False)["segment_error"], RUN).edges


@query
def graph_segments_nodes(spark, sf):
    nodes = GR.segment_graph(_aggregates(spark, sf, False)["segment_error"], RUN).nodes
    return nodes.where(F.col("label") == GR.SEGMENT).drop("code", "hour", "hour_label")


@query
def graph_upsert(spark, sf):
    model, baseline = _predictions(spark, sf)
    old = D.line_ranking(D.clean_predictions(baseline), "baseline", SUPPORT["min_line"])
    new = D.line_ranking(D.clean_predictions(model), "model", SUPPORT["min_line"])
    return GR.upsert(GR.line_rank_graph(old, "run_baseline"), GR.line_rank_graph(new, RUN)).nodes


@query
def graph_purge(spark, sf):
    return GR.purge(_graph(spark, sf)).nodes.select("label", "id", "latest_line_rank", "latest_vehicle_rank")


@query
def graph_unique_violations(spark, sf):
    """Nodes of two runs put together without merging: what both runs rank is there twice."""
    model, baseline = _predictions(spark, sf)
    runs = [D.line_ranking(D.clean_predictions(p), name, SUPPORT["min_line"]) for p, name in ((model, "model"), (baseline, "baseline"))]
    nodes = [GR.line_rank_graph(ranking, name).nodes for ranking, name in zip(runs, (RUN, "run_baseline"))]
    return GR.unique_violations(nodes[0].unionByName(nodes[1], allowMissingColumns=True))


@query
def gq_top_lines(spark, sf):
    return GR.top_lines(_graph(spark, sf, "lines"), RUN)


@query
def gq_top_hours(spark, sf):
    return GR.top_hours(_graph(spark, sf, "hours"), RUN)


@query
def gq_top_vehicles(spark, sf):
    return GR.top_vehicles(_graph(spark, sf, "vehicles"), RUN)


@query
def gq_gap_vs_baseline(spark, sf):
    return GR.gap_vs_baseline(_graph(spark, sf, "line_hours"), RUN)


@query
def gq_overview(spark, sf):
    return GR.overview(_graph(spark, sf, "lines", "hours", "vehicles"), RUN)


@query
def gq_line_focus(spark, sf):
    return GR.line_focus(_graph(spark, sf, "lines", "segments"), RUN)


@query
def gq_segment_focus(spark, sf):
    return GR.segment_focus(_graph(spark, sf, "segments"), RUN)


# --- semantic layer ---------------------------------------------------------------------------------------------------
@query
def semantic_links(spark, sf):
    return S.semantic_links(_tagged(spark, sf))


@query
def semantic_properties(spark, sf):
    return S.semantic_properties(_tagged(spark, sf))


@query
def semantic_entities(spark, sf):
    return S.semantic_entities(_tagged(spark, sf))


@query
def semantic_summary(spark, sf):
    return S.semantic_summary(_tagged(spark, sf))


@query
def semantic_table_class(spark, sf):
    return S.semantic_table_class(_tagged(spark, sf))


@query
def semantic_rule_hits(spark, sf):
    """Some event times are blanked, as in ``canonical_timestamp``, so that every rule has hits."""
    blanked = F.when(F.col("event_id").cast("bigint") % 13 != 0, F.col("event_ts"))
    return S.semantic_rule_hits(AVL.points(spark, sf).withColumn("event_ts", blanked))
