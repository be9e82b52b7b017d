"""Headway and Gold on hand-made and random stop rows, against brute force."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from headwise.operators import gold as G
from headwise.operators import headway as H
from headwise.operators import quality as Q
from headwise.operators.silver import stack_tables
from headwise.schemas import SILVER_COLUMNS

DAY = dt.date(2024, 1, 1)
T0 = 1704067200
TYPES = {
    "event_id": "string", "event_ts": "bigint", "event_dt": "date", "created_at_origem": "timestamp_ntz",
    "created_at_ingestao": "timestamp_ntz", "tipo_mensagem": "string", "sequencial": "bigint", "id_empresa": "int",
    "cod_linha": "int", "cod_veiculo": "int", "cod_garagem": "int", "cod_operador": "bigint", "gps_idx": "int",
    "gps_timestamp_utc_geracao": "bigint", "latitude_raw": "double", "longitude_raw": "double", "latitude": "double",
    "longitude": "double", "velocidade": "double", "direcao": "double", "numero_satelites": "int", "hdop": "double",
    "pdop": "double", "odometro_calculado": "double", "lat_erro": "double", "lon_erro": "double", "id_ponto": "int",
}


def table(spark, name, rows):
    columns = SILVER_COLUMNS[name]
    ddl = ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in columns)
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ddl)


def stop(event_id, second, line=1, vehicle=1, direction="I", gps_idx=0, day=DAY, **more):
    return {"event_id": event_id, "event_ts": T0 + second, "event_dt": day, "cod_linha": line, "cod_veiculo": vehicle,
            "viagem_sentido": direction, "gps_idx": gps_idx, "id_empresa": 1, "latitude": 1.0, "longitude": 2.0,
            "tipo_mensagem": "AVL_EVT_ENTRADA_SAIDA_PONTO", **more}


def tables(spark, stops, extra=()):
    return {
        "gps_events": table(spark, "gps_events", [s for s in [*stops, *extra] if s["gps_idx"] is not None]),
        "stop_events": table(spark, "stop_events", stops),
        "fare_events": table(spark, "fare_events", []),
        "operational_events": table(spark, "operational_events", []),
    }


def brute_force_gaps(stops):
    groups = defaultdict(list)
    for s in stops:
        key = (s["event_dt"], -1 if s["cod_linha"] is None else s["cod_linha"], s["viagem_sentido"] or "ND")
        groups[key].append((s["event_ts"], s["event_id"], s["gps_idx"]))
    out = []
    for key, rows in groups.items():
        rows.sort()
        for before, row in zip(rows, rows[1:]):
            gap = (row[0] - before[0]) / 60.0
            if 0 < gap <= 180:
                out.append((*key, row[0] - row[0] % 300, gap))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_observed_headway_equals_row_level_lag(spark, seed):
    rng = random.Random(seed)
    # one line holds most rows, many at the same second, some keys missing, some gaps too long
    stops = [
        stop(f"e{i}", rng.choice([rng.randrange(0, 4000), rng.randrange(0, 80000)]),
             line=rng.choice([5, 5, 5, 5, 1, None]), direction=rng.choice(["I", "V", None]), gps_idx=g)
        for i in range(400) for g in range(rng.randrange(1, 4))
    ]
    want = defaultdict(list)
    for day, line, direction, window, gap in brute_force_gaps(stops):
        want[day, line, direction, window].append(gap)
    got = H.headway_observed(table(spark, "stop_events", stops)).collect()
    assert len(got) == len(want)
    for r in got:
        seconds = int((r["janela_5min"] - dt.datetime(1970, 1, 1)).total_seconds())
        gaps = want[r["event_dt"], r["cod_linha"], r["viagem_sentido"], seconds]
        assert r["n_eventos_ponto"] == len(gaps)
        assert r["headway_observado_min"] == pytest.approx(sum(gaps) / len(gaps))


def test_arrival_rows_are_conserved(spark):
    stops = [stop("a", 0), stop("a", 0, gps_idx=1), stop("b", 60), stop("c", 60)]
    rows = {r["event_ts"] - T0: r for r in H.headway_gaps(table(spark, "stop_events", stops)).collect()}
    assert rows[0]["rows_at_second"] == 2 and rows[0]["headway_diff_min"] is None
    assert rows[60]["rows_at_second"] == 2 and rows[60]["headway_diff_min"] == 1.0


def test_reference_is_the_lower_median_and_can_stop_early(spark):
    def window(day, value):
        return (day, 1, "I", 8, float(value))
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]
    observed = spark.createDataFrame(
        [window(d, v) for d, v in zip(days, (1, 2, 3, 4))],
        "event_dt date, cod_linha int, viagem_sentido string, faixa_horaria int, headway_observado_min double")
    assert H.headway_reference(observed).first()["headway_referencia_min"] == 2.0
    assert H.headway_reference(observed, "2024-01-01").first()["headway_referencia_min"] == 1.0


def test_gold_rows_keys_and_empty_targets(spark):
    stops = [stop("a", 10), stop("b", 130), stop("c", 400), stop("z", 20, line=2), stop("n", 30, line=None, gps_idx=None)]
    gold = G.build_gold(tables(spark, stops)).collect()
    keys = [(r["event_dt"], r["cod_linha"], r["cod_veiculo"], r["janela_5min"]) for r in gold]
    assert len(keys) == len(set(keys)) == 4
    by_line = {r["cod_linha"]: r for r in gold}
    # a lone stop has no gap: its target is missing, not zero
    assert by_line[2]["atraso_aproximado_min"] is None and by_line[2]["headway_observado_min"] is None
    # the message without points has no vehicle context
    assert by_line[-1]["id_empresa"] == -1 and by_line[-1]["qtd_eventos_gps"] == 0 and by_line[-1]["gps_invalid_pct"] == 0.0
    assert all(r["atraso_aproximado_min"] >= 0 for r in gold if r["atraso_aproximado_min"] is not None)


def test_first_values_skip_nulls_and_break_ties(spark):
    rows = [stop("b", 5, direction="V"), stop("a", 5, direction="I"), stop("0", 1, direction=None, id_empresa=None),
            stop("a", 5, direction="X", gps_idx=1)]
    got = G.vehicle_window_context(table(spark, "gps_events", rows)).first()
    assert (got["viagem_sentido"], got["id_empresa"], got["qtd_eventos_gps"]) == ("I", 1, 4)
    assert G.stop_vehicle_windows(table(spark, "stop_events", rows[2:3])).first()["viagem_sentido"] == "ND"


def test_union_conserves_rows_and_strict_union_refuses(spark):
    t = tables(spark, [stop("a", 1), stop("b", 2, gps_idx=None)], [stop("p", 3, tipo_mensagem="AVL_EVT_POSICIONAMENTO")])
    assert G.union_events(t).count() == sum(f.count() for f in t.values()) == 4
    with pytest.raises(AnalysisException):
        G.union_events_strict(t).count()
    with pytest.raises(ValueError, match="missing table"):
        G.union_events({k: v for k, v in t.items() if k != "fare_events"})
    with pytest.raises(ValueError, match="lacks columns"):
        G.union_events({**t, "gps_events": t["gps_events"].drop("latitude")})


def test_custom_contract_limits_the_keys(spark):
    t = tables(spark, [stop("a", 1), stop("b", 400)])
    assert G.materialize_gold(t).count() == 2
    assert G.materialize_gold(t, G.contract_table).count() == 2
    first = G.materialize_gold(t, lambda x: G.contract_table(x).where("minute(janela_5min) = 0"), partitions=3)
    assert first.count() == 1 and first.rdd.getNumPartitions() <= 3


def test_contract_keys_are_combined_before_the_join(spark):
    t = tables(spark, [stop(f"e{i}", i % 3) for i in range(50)] + [stop("x", 400, vehicle=None), stop("y", 700, line=None)])
    windows, context = G.stop_vehicle_windows(t["stop_events"]), G.vehicle_window_context(t["gps_events"])
    kept = G.stop_windows_with_context(windows, context, G.contract_table(t).where("minute(janela_5min) < 10"))
    assert sorted((r.cod_veiculo, r.qtd_eventos_stop) for r in kept.collect()) == [(-1, 1), (1, 50)]
    lines = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "Join LeftSemi" in x)
    child = lines[at].index("Join LeftSemi")  # where the marks of its two sides stand
    right = next(x for x in lines[at + 1:] if x[child:child + 2] == "+-")
    assert "Aggregate [event_dt" in right  # a row per window, not per point


def test_contract_violations(spark):
    good = G.contract_table(tables(spark, [stop("a", 1)]))
    G.assert_contract(good)
    with pytest.raises(ValueError, match="contract columns missing"):
        G.check_contract_schema(good.drop("janela_5min"))
    with pytest.raises(TypeError):
        G.check_contract_schema(good.withColumn("headway_observado_min", F.lit(8)))
    with pytest.raises(ValueError, match="contract violated"):
        G.assert_contract(good.withColumn("cod_linha", F.lit(None).cast("int")))
    with pytest.raises(ValueError, match="contract violated"):
        G.assert_contract(good.withColumns({"latitude": F.lit(91.0), "longitude": F.lit(0.0)}))


def test_alignment_counts_copies_once_per_key(spark):
    stops = [stop("a", 1)] * 50 + [stop("b", 2)]
    rows = {r["event_id"]: r for r in G.align_events(tables(spark, stops)).collect()}
    assert len(rows) == 2
    assert rows["a"]["gps_rows"] == rows["a"]["stop_rows"] == 50 and rows["a"]["fare_event_ts"] is None


def test_duplicates_key_rule(spark):
    t = tables(spark, [stop("a", 1), stop("a", 1), stop("b", 2, gps_idx=None), stop("b", 2, gps_idx=None)])
    t["fare_events"] = table(spark, "fare_events", [stop("f", 1, gps_idx=None), stop("f", 2, gps_idx=None)])
    got = {r["table_name"]: r for r in Q.dq_duplicates(stack_tables(t)).collect()}
    assert (got["stop_events"]["key_rule"], got["stop_events"]["duplicate_rows"]) == ("event_id+gps_idx", 2)
    assert (got["fare_events"]["key_rule"], got["fare_events"]["duplicate_rows"]) == ("event_id", 1)
    by_day = {r["table_name"]: r for r in Q.dq_duplicates_by_day(stack_tables(t)).collect()}
    assert {k: r["duplicate_rows"] for k, r in by_day.items()} == {k: r["duplicate_rows"] for k, r in got.items()}


def test_checks_on_absent_columns_are_null(spark):
    rows = [stop("a", 1, hdop=float("nan"), direcao=400.0, velocidade=-1.0)]
    t = tables(spark, rows)
    got = {r["table_name"]: r for r in Q.dq_nulls_types(stack_tables(t)).collect()}
    assert got["gps_events"]["invalid_hdop_nan_rows"] == 1 and got["stop_events"]["invalid_hdop_nan_rows"] is None
    assert got["gps_events"]["invalid_numeric_total_rows"] == 3 and got["stop_events"]["invalid_numeric_total_rows"] == 2


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_gold_plan(spark, sf_dir):
    from headwise.plans import avl_projection as AVL

    plan = plan_of(G.build_gold(AVL.tables(spark, sf_dir)))
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan
    assert "props" not in plan  # the unused column is not read


def test_raw_rows_are_hashed_not_sorted(spark, sf_dir):
    from headwise.plans import avl_projection as AVL

    tables_ = AVL.tables(spark, sf_dir)
    for frame in (G.vehicle_window_context(tables_["gps_events"]), G.stop_vehicle_windows(tables_["stop_events"])):
        first_step = plan_of(frame).rsplit("Exchange", 1)[1]
        assert "HashAggregate" in first_step and "SortAggregate" not in first_step and "Sort [" not in first_step


def test_arrival_shuffle_is_reused(spark, sf_dir):
    from headwise.plans import avl_projection as AVL

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(G.build_gold(AVL.tables(spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "ReusedExchange" in plan and plan.count("FileScan") == 3


def test_gap_rows_shuffle_raw_rows_once_and_split_a_busy_line(spark):
    drawn = random.Random(5)
    data = []
    for i in range(3000):  # one line holds most rows
        line = 1 if i % 3 else drawn.choice([2, None])
        data.append((f"e{drawn.randrange(900):04d}", drawn.choice([None, 0, 1]), 7, dt.date(2024, 1, 1), line, drawn.choice(["A", None]),
                     1704067200 + drawn.choice([drawn.randrange(86400), 600 * drawn.randrange(144), 40000 + drawn.randrange(30)])))
    data += data[:40]  # copies follow each other at once
    columns = "event_id string, gps_idx int, id_ponto int, event_dt date, cod_linha int, viagem_sentido string, event_ts bigint"
    stops = spark.createDataFrame(data + [("n", 0, 7, dt.date(2024, 1, 1), 1, "A", None)], columns)
    last, want = {}, []
    for r in sorted(data, key=lambda r: (r[6], r[0], -1 if r[1] is None else r[1])):
        group = (r[3], -1 if r[4] is None else r[4], r[5] or "ND")
        want.append((r[0], r[1], *group, r[6], None if group not in last else (r[6] - last[group]) / 60.0))
        last[group] = r[6]
    frame = H.headway_gap_rows(stops)
    got = [(r.event_id, r.gps_idx, r.event_dt, r.cod_linha, r.viagem_sentido, r.event_ts, r.headway_diff_min) for r in frame.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frame = H.headway_gap_rows(stops)
        plan = plan_of(frame)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("SortMergeJoin") == 1 and "SortAggregate" not in plan
    raw = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(raw) == 4  # rows by slice; last seconds by slice, by day, and back by slice for the join


def test_validation_hashes(spark, sf_dir):
    from headwise.operators import silver as SV
    from headwise.plans import avl_projection as AVL

    plan = plan_of(SV.validate_tagged(SV.tag_tables(AVL.points(spark, sf_dir))))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
