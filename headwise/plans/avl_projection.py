"""Vehicle telemetry derived from the ``events`` table (see FIXTURES.md).

There is no raw feed to test on, so each event row stands for one vehicle message. ``bronze_messages`` gives it the nested
shape of the feed, for the queries about parsing and flattening; ``points`` gives the same data as flat Silver rows, for
everything that starts from stored Silver. The flat form computes only the columns a query uses, as a scan of Silver would
read only those. Nothing shuffles in either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.functions.clock import UNIX_EPOCH, epoch_sql
from headwise.operators.messages import flatten_avl_header, message_points
from headwise.operators.silver import silver_tables
from headwise.schemas import COORDINATE_SCALE

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
# FIXTURES.md section 3; `event_s` is the compressed epoch second of the message
EVENT_SECOND = f"1704067200 + ({epoch_sql('ts')} - 1704067200) div 10"
ISO = "concat(replace(cast(timestampadd(SECOND, event_s + {shift}, " + UNIX_EPOCH + ") as string), ' ', 'T'), 'Z')"

POINT = """
named_struct(
  'timestampUtcGeracao', event_s - i,
  'sinalGps', case when (event_id + i) % 4 = 0 then 'AVL_QUALIDADE_SINAL_INVALIDO'
                   else 'AVL_QUALIDADE_SINAL_VALIDO' end,
  'latitude', case when (event_id + i) % 11 = 0 then null
                   when (event_id + i) % 307 = 0 then cast(40000000 as double)
                   else cast(-1350000 - (event_id % 1000) * 10 - i as double) end,
  'longitude', case when (event_id + i) % 13 = 0 then null
                    else cast(-13860000 - (event_id % 1000) * 10 - i as double) end,
  'velocidade', case when event_id % 401 = 0 then cast(-1 as double) else value + i end,
  'direcao', case when event_id % 503 = 0 then cast(400 as double)
                  else cast((event_id * 7 + i) % 361 as double) end,
  'numeroSatelites', (event_id + i) % 19,
  'hdop', case when event_id % 601 = 0 then cast('NaN' as double)
               else cast(event_id % 50 as double) / cast(10 as double) end,
  'pdop', cast(event_id % 40 as double) / cast(10 as double),
  'odometroCalculado', cast(event_id * 100 + i as double),
  'latErro', cast(event_id % 7 as double),
  'lonErro', cast(event_id % 5 as double))
"""

MESSAGE = [
    "named_struct('$oid', cast(event_id as string)) as _id",
    "event_s as timestamp",
    f"named_struct('$date', {ISO.format(shift=5)}) as createdAt",
    f"named_struct('$date', {ISO.format(shift=2)}) as createdAtOrigem",
    f"""
    named_struct(
      'tipoMensagem', case when event_id % 1009 = 0 then null
                           when event_type = 'view' then 'AVL_EVT_POSICIONAMENTO'
                           when event_type in ('click', 'signup') then 'AVL_EVT_ENTRADA_SAIDA_PONTO'
                           when event_type = 'purchase' then 'AVL_EVT_PASSAGEM_CARTAO'
                           when event_id % 2 = 0 then 'AVL_EVT_RECARGA'
                           else 'AVL_EVT_LIGA_DESLIGA' end,
      'sequencial', event_id * 10,
      'dataHora', cast(timestampadd(SECOND, event_s, {UNIX_EPOCH}) as string),
      'validador', named_struct(
          'idEmpresa', case when event_id % 211 = 0 then null else user_id % 5 end,
          'codLinha', case when event_id % 97 = 0 then null else user_id % 3 end,
          'prefixoLinha', concat('L', cast(user_id % 3 as string)),
          'codVeiculo', user_id % 20,
          'prefixoVeiculo', concat('V', cast(user_id % 20 as string)),
          'codGaragem', user_id % 4),
      'jornada', named_struct(
          'codOperador', case when event_id % 6 = 0 then null else user_id end,
          'codTabelaProgramacao', case when event_id % 9 = 0 then null else concat('T', cast(user_id % 7 as string)) end),
      'viagem', named_struct(
          'sentido', case when event_id % 5 = 0 then null
                          when event_id % 2 = 0 then 'AVL_SENTIDO_IDA' else 'AVL_SENTIDO_VOLTA' end),
      'sensores', named_struct(
          'statusIgnicao', case when event_id % 3 = 0 then 'LIGADA' else 'DESLIGADA' end,
          'statusPanico', case when event_id % 701 = 0 then 'ATIVO' else 'INATIVO' end),
      'gps', case when event_id % 4 = 0 then null
                  else transform(sequence(0L, event_id % 4 - 1), i -> {POINT}) end) as avlHeader
    """,
    f"""
    named_struct(
      'idPonto', case when event_type in ('click', 'signup') then event_id % 50 end,
      'eventoPonto', case when event_type = 'click' then 'ENTRADA' when event_type = 'signup' then 'SAIDA' end)
      as avlEventoEntradaSaidaPonto
    """,
]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # declared schema: no job just to look at a footer
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet").withColumn("event_s", F.expr(EVENT_SECOND))


def bronze_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*MESSAGE)


def flat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_avl_header(bronze_messages(spark, sf_dir))


POINT_ROWS = [
    "cast(event_id as string) as event_id",
    "case when event_id % 1009 = 0 then null when event_type = 'view' then 'AVL_EVT_POSICIONAMENTO' "
    "when event_type in ('click', 'signup') then 'AVL_EVT_ENTRADA_SAIDA_PONTO' "
    "when event_type = 'purchase' then 'AVL_EVT_PASSAGEM_CARTAO' "
    "when event_id % 2 = 0 then 'AVL_EVT_RECARGA' else 'AVL_EVT_LIGA_DESLIGA' end as tipo_mensagem",
    "event_id * 10 as sequencial",
    "case when event_id % 211 = 0 then null else cast(user_id % 5 as int) end as id_empresa",
    "case when event_id % 97 = 0 then null else cast(user_id % 3 as int) end as cod_linha",
    "concat('L', cast(user_id % 3 as string)) as prefixo_linha",
    "cast(user_id % 20 as int) as cod_veiculo",
    "concat('V', cast(user_id % 20 as string)) as prefixo_veiculo",
    "cast(user_id % 4 as int) as cod_garagem",
    "case when event_id % 6 = 0 then null else user_id end as cod_operador",
    "case when event_id % 9 = 0 then null else concat('T', cast(user_id % 7 as string)) end as cod_tabela_programacao",
    "case when event_id % 5 = 0 then null when event_id % 2 = 0 then 'AVL_SENTIDO_IDA' else 'AVL_SENTIDO_VOLTA' end "
    "as viagem_sentido",
    "case when event_id % 3 = 0 then 'LIGADA' else 'DESLIGADA' end as status_ignicao",
    "case when event_id % 701 = 0 then 'ATIVO' else 'INATIVO' end as status_panico",
    "case when event_type in ('click', 'signup') then cast(event_id % 50 as int) end as id_ponto",
    "case when event_type = 'click' then 'ENTRADA' when event_type = 'signup' then 'SAIDA' end as evento_ponto",
    "cast(i as int) as gps_idx",
    "event_s as event_ts",
    f"to_date(timestampadd(SECOND, event_s, {UNIX_EPOCH})) as event_dt",
    f"timestampadd(SECOND, event_s + 2, {UNIX_EPOCH}) as created_at_origem",
    f"timestampadd(SECOND, event_s + 5, {UNIX_EPOCH}) as created_at_ingestao",
    "event_s - i as gps_timestamp_utc_geracao",
    "case when i is null then null when (event_id + i) % 4 = 0 then 'AVL_QUALIDADE_SINAL_INVALIDO' "
    "else 'AVL_QUALIDADE_SINAL_VALIDO' end as gps_sinal",
    "case when i is null or (event_id + i) % 11 = 0 then null when (event_id + i) % 307 = 0 then cast(40000000 as double) "
    "else cast(-1350000 - (event_id % 1000) * 10 - i as double) end as latitude_raw",
    "case when i is null or (event_id + i) % 13 = 0 then null "
    "else cast(-13860000 - (event_id % 1000) * 10 - i as double) end as longitude_raw",
    "case when i is null then null when event_id % 401 = 0 then cast(-1 as double) else value + i end as velocidade",
    "case when i is null then null when event_id % 503 = 0 then cast(400 as double) "
    "else cast((event_id * 7 + i) % 361 as double) end as direcao",
    "case when i is not null then cast((event_id + i) % 19 as int) end as numero_satelites",
    "case when i is null then null when event_id % 601 = 0 then cast('NaN' as double) "
    "else cast(event_id % 50 as double) / cast(10 as double) end as hdop",
    "case when i is not null then cast(event_id % 40 as double) / cast(10 as double) end as pdop",
    "case when i is not null then cast(event_id * 100 + i as double) end as odometro_calculado",
    "case when i is not null then cast(event_id % 7 as double) end as lat_erro",
    "case when i is not null then cast(event_id % 5 as double) end as lon_erro",
]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per GPS point (or per message without points), as the message chain would leave it."""
    points_of = "explode_outer(case when event_id % 4 = 0 then null else sequence(0L, event_id % 4 - 1) end) as i"
    return (
        _events(spark, sf_dir)
        .selectExpr("event_id", "event_s", "user_id", "event_type", "value", points_of)
        .selectExpr(*POINT_ROWS)
        .withColumns({
            "latitude": F.col("latitude_raw") / F.lit(COORDINATE_SCALE),
            "longitude": F.col("longitude_raw") / F.lit(COORDINATE_SCALE),
        })
    )


def parsed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows through the nested message and the real flattening chain."""
    return message_points(bronze_messages(spark, sf_dir))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return silver_tables(points(spark, sf_dir), names or None)


def gold_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The two tables Gold is built from."""
    return tables(spark, sf_dir, "gps_events", "stop_events")
