"""Bronze to Silver on hand-made messages."""

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from headwise.functions.clock import local_time, window_start
from headwise.functions.rules import canonical_timestamp, gps_is_invalid, with_fallback_keys
from headwise.operators.messages import explode_gps, flatten_avl_header, message_points
from headwise.operators.silver import (
    ingest, limit_rows, sample_rows, silver_table, silver_tables, stack_tables, tag_tables, validate_silver,
)
from headwise.schemas import SILVER_COLUMNS
from headwise.sources.lake import between_days, load_silver, read_bronze, read_partitioned, write_gold, write_silver


def message(oid, ts, kind, gps, line=7, **validator):
    return {
        "_id": {"$oid": oid}, "timestamp": ts,
        "createdAt": {"$date": "2023-02-28T03:00:06.250Z"}, "createdAtOrigem": {"$date": "2023-02-28T03:00:02Z"},
        "avlHeader": {
            "tipoMensagem": kind, "sequencial": 1, "dataHora": "x",
            "validador": {"idEmpresa": 3, "codLinha": line, "codVeiculo": 11, "codGaragem": 2, "prefixoLinha": "07",
                          "prefixoVeiculo": "V", **validator},
            "jornada": {"codOperador": 5, "codTabelaProgramacao": "T1"}, "viagem": {"sentido": "AVL_SENTIDO_IDA"},
            "sensores": {"statusIgnicao": "LIGADA", "statusPanico": "INATIVO"}, "gps": gps,
        },
        "avlEventoEntradaSaidaPonto": {"idPonto": 9, "eventoPonto": "ENTRADA"},
    }


def point(lat=-1350000, lon=-13860000, signal="AVL_QUALIDADE_SINAL_VALIDO"):
    return {"timestampUtcGeracao": 1, "sinalGps": signal, "latitude": lat, "longitude": lon, "velocidade": 10.5,
            "direcao": 90, "numeroSatelites": 8, "hdop": 0.9, "pdop": 1.1, "odometroCalculado": 100, "latErro": 0,
            "lonErro": 0}


@pytest.fixture(scope="module")
def bronze(spark, tmp_path_factory):
    file = tmp_path_factory.mktemp("bronze") / "messages.json"
    lines = [
        message("a", 1677553201, "AVL_EVT_POSICIONAMENTO", [point(), point(lat=None)]),
        message("b", 1677553202, "AVL_EVT_ENTRADA_SAIDA_PONTO", []),
        message("c", 1677553203, "AVL_EVT_PASSAGEM_CARTAO", None),
        message("d", 1677553204, "AVL_EVT_RECARGA", [point(signal="AVL_QUALIDADE_SINAL_INVALIDO")]),
        message("e", 1677553205, None, [point(lat=40000000)]),
        message("f", 1677553206, "AVL_EVT_ENTRADA_SAIDA_PONTO", [point()], line=2**40),
    ]
    file.write_text("\n".join(json.dumps(m) for m in lines) + "\nnot json\n")
    return read_bronze(spark, str(file))


def test_corrupt_line_is_kept(bronze):
    bad = bronze.where("_corrupt_record is not null").select("_corrupt_record", "_id").collect()
    assert [tuple(r) for r in bad] == [("not json", None)]


def test_flatten_has_21_columns_and_tolerates_overflow(bronze):
    flat = flatten_avl_header(bronze.where("_corrupt_record is null"))
    assert len(flat.columns) == 21
    rows = {r["event_id"]: r for r in flat.collect()}
    assert rows["a"]["cod_linha"] == 7 and rows["f"]["cod_linha"] is None


def test_explode_keeps_messages_without_points(bronze):
    rows = explode_gps(flatten_avl_header(bronze.where("_corrupt_record is null"))).select("event_id", "gps_idx").collect()
    assert sorted((r[0], r[1]) for r in rows if r[0] in "abc" and r[1] is not None) == [("a", 0), ("a", 1)]
    assert {(r[0], r[1]) for r in rows if r[1] is None} == {("b", None), ("c", None)}


def test_zone_moves_the_day(bronze):
    utc = message_points(bronze).where("event_id = 'a'").first()
    local = message_points(bronze, "America/Fortaleza").where("event_id = 'a'").first()
    assert utc["event_dt"] == dt.date(2023, 2, 28) and local["event_dt"] == dt.date(2023, 2, 28)
    assert utc["created_at_ingestao"] == dt.datetime(2023, 2, 28, 3, 0, 6, 250000)
    assert local["created_at_ingestao"] == dt.datetime(2023, 2, 28, 0, 0, 6, 250000)
    early = message_points(bronze.withColumn("timestamp", F.lit(1677553199).cast("bigint")), "America/Fortaleza").first()
    assert early["event_dt"] == dt.date(2023, 2, 27)


def test_session_zone_is_irrelevant(spark):
    frame = spark.range(1).select(local_time(F.lit(1677553201)).alias("t"), window_start(F.lit(-1)).alias("w"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        row = frame.first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row["t"] == dt.datetime(2023, 2, 28, 3, 0, 1)
    assert row["w"] == dt.datetime(1969, 12, 31, 23, 55)


def test_coordinates(bronze):
    rows = {(r["event_id"], r["gps_idx"]): r for r in message_points(bronze).collect()}
    assert rows["a", 0]["latitude"] == -3.75 and rows["a", 0]["longitude"] == -38.5
    assert rows["a", 1]["latitude"] is None and rows["a", 1]["latitude_raw"] is None
    assert rows["d", 0]["latitude_raw"] == -1350000.0


def test_routing_is_complete(bronze):
    points = message_points(bronze.where("_corrupt_record is null"))
    counts = {name: table.count() for name, table in silver_tables(points).items()}
    # every point of every type, and the untyped message only there
    assert counts == {"gps_events": 5, "stop_events": 2, "fare_events": 1, "operational_events": 1}
    assert {n: len(c) for n, c in SILVER_COLUMNS.items()} == {
        "gps_events": 33, "stop_events": 30, "fare_events": 28, "operational_events": 28}
    tagged = {r["table_name"]: r["count"] for r in tag_tables(points).groupBy("table_name").count().collect()}
    stacked = {r["table_name"]: r["count"] for r in
               stack_tables(silver_tables(points)).groupBy("table_name").count().collect()}
    assert tagged == stacked == counts


def test_flag_is_two_valued(spark):
    frame = spark.createDataFrame(
        [("ok", "AVL_QUALIDADE_SINAL_VALIDO", 1.0, 1.0), ("null signal", None, 1.0, 1.0),
         ("bad", "AVL_QUALIDADE_SINAL_INVALIDO", 1.0, 1.0), ("no lat", None, None, 1.0),
         ("range", "AVL_QUALIDADE_SINAL_VALIDO", 111.1, 1.0), ("edge", "AVL_QUALIDADE_SINAL_VALIDO", -90.0, 180.0)],
        "name string, gps_sinal string, latitude double, longitude double")
    got = {r["name"]: r["f"] for r in frame.select("name", gps_is_invalid().alias("f")).collect()}
    assert got == {"ok": False, "null signal": False, "bad": True, "no lat": True, "range": True, "edge": False}


def test_fallbacks_keep_the_schedule_null(spark):
    frame = spark.createDataFrame([(None, None, None, None, None)],
                                  "id_empresa int, cod_linha int, cod_veiculo int, viagem_sentido string, "
                                  "cod_tabela_programacao string")
    assert tuple(with_fallback_keys(frame).first()) == (-1, -1, -1, "ND", None)


def test_canonical_timestamp_order(spark):
    o, i = dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 2)
    frame = spark.createDataFrame([(0, o, i), (None, o, i), (None, None, i)],
                                  "event_ts bigint, created_at_origem timestamp_ntz, created_at_ingestao timestamp_ntz")
    assert [r[0] for r in frame.select(canonical_timestamp()).collect()] == [dt.datetime(1970, 1, 1), o, i]


def test_validation_of_empty_table_fails(spark, bronze):
    empty = silver_table(message_points(bronze).where("false"), "fare_events")
    assert validate_silver(empty, "fare_events").first()["rows"] == 0
    with pytest.raises(Exception, match="fare_events has no rows"):
        validate_silver(empty, "fare_events", fail_when_empty=True).collect()


def test_sample_and_limit_arguments(bronze):
    for fraction in (0.0, -0.1, 1.1):
        with pytest.raises(ValueError):
            sample_rows(bronze, fraction)
    with pytest.raises(ValueError):
        limit_rows(bronze, 0)
    assert sample_rows(bronze, 1.0).count() == bronze.count()


def test_bad_day_fails_early(bronze):
    with pytest.raises(ValueError):
        between_days(message_points(bronze), "2024-13-01")


def test_slice_overwrite_keeps_other_days_and_prunes(spark, tmp_path):
    columns = "event_id string, event_dt date, tipo_mensagem string, id_empresa int"
    def rows(day, tag, n=3):
        return spark.createDataFrame([(f"{tag}{i}", day, None if i == 0 else "T", i) for i in range(n)], columns)
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    base = str(tmp_path)
    write_silver(rows(first, "a").union(rows(second, "b")), base, "gps_events")
    write_silver(rows(second, "c"), base, "gps_events")
    back = read_partitioned(spark, f"{base}/gps_events", rows(first, "a").schema)
    assert {r["event_id"] for r in back.collect()} == {"a0", "a1", "a2", "c0", "c1", "c2"}
    assert back.where("tipo_mensagem is null").count() == 2
    pruned = between_days(back, second, second)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_dt" in plan
    assert pruned.count() == 3


def test_rewritten_days_keep_nothing_old(spark, tmp_path):
    columns = "event_id string, event_dt date, tipo_mensagem string, id_empresa int"
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    base = str(tmp_path)
    rows = [("a", first, "T", 1), ("b", second, "T", 1), ("c", second, None, 2), ("d", second, "T", None)]
    write_silver(spark.createDataFrame(rows, columns), base, "stop_events")
    write_silver(spark.createDataFrame([("b", second, "U", 99), ("c", second, "U", 99)], columns), base, "stop_events")
    back = read_partitioned(spark, f"{base}/stop_events", spark.createDataFrame([], columns).schema)
    assert sorted(map(tuple, back.select("event_id", "tipo_mensagem", "id_empresa").collect())) == [
        ("a", "T", 1), ("b", "U", 99), ("c", "U", 99)]
    write_silver(spark.createDataFrame(rows[:1], columns), base, "stop_events", mode="append")
    assert back.sparkSession.read.parquet(f"{base}/stop_events").count() == 4


def test_ingest_parses_the_feed_once(spark, bronze, tmp_path):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        read.add(1)
        return value

    lines = bronze.where("_corrupt_record is null").withColumn("timestamp", seen.asNondeterministic()(F.col("timestamp").cast("string")).cast("bigint"))
    ingest(message_points(lines), str(tmp_path))
    assert read.value == sum(r["_corrupt_record"] is None for r in bronze.collect())


def test_rebalance_before_partitioned_write(spark):
    frame = spark.createDataFrame([("x", dt.date(2024, 1, 1), "T", 1)],
                                  "event_id string, event_dt date, tipo_mensagem string, id_empresa int")
    plan = frame.hint("rebalance", "event_dt")._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan


def test_ingest_and_load(spark, bronze, tmp_path):
    ingest(message_points(bronze.where("_corrupt_record is null")), str(tmp_path))
    schemas = {n: t.schema for n, t in silver_tables(message_points(bronze)).items()}
    loaded = load_silver(spark, str(tmp_path), "2023-02-28", "2023-02-28", schemas)
    assert {n: t.count() for n, t in loaded.items()} == {
        "gps_events": 5, "stop_events": 2, "fare_events": 1, "operational_events": 1}


def test_gold_other_format(spark, tmp_path):
    frame = spark.createDataFrame([(dt.date(2024, 1, 1), 1)], "event_dt date, cod_linha int")
    path = write_gold(frame, str(tmp_path / "json"), fmt="json")
    assert spark.read.json(path).count() == 1


def test_window_on_plain_seconds_is_refused(spark):
    # a window function over plain seconds is refused by Spark, hence the arithmetic in clock.py
    with pytest.raises(AnalysisException):
        spark.range(1).select(F.window("id", "5 minutes")).collect()
