"""Bronze message -> one row per GPS point, typed and normalised. Narrow steps only: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.functions.clock import instant_to_local, local_time
from headwise.schemas import COORDINATE_SCALE

# fixed values: target column -> (message path, cast or None to keep the type)
HEADER_PATHS = {
    "event_id": ("_id.$oid", None),
    "event_ts_raw": ("timestamp", "bigint"),
    "created_at_origem_raw": ("createdAtOrigem.$date", None),
    "created_at_ingestao_raw": ("createdAt.$date", None),
    "tipo_mensagem": ("avlHeader.tipoMensagem", None),
    "sequencial": ("avlHeader.sequencial", "bigint"),
    "data_hora_header": ("avlHeader.dataHora", None),
    "id_empresa": ("avlHeader.validador.idEmpresa", "int"),
    "cod_linha": ("avlHeader.validador.codLinha", "int"),
    "prefixo_linha": ("avlHeader.validador.prefixoLinha", None),
    "cod_veiculo": ("avlHeader.validador.codVeiculo", "int"),
    "prefixo_veiculo": ("avlHeader.validador.prefixoVeiculo", None),
    "cod_garagem": ("avlHeader.validador.codGaragem", "int"),
    "cod_operador": ("avlHeader.jornada.codOperador", "bigint"),
    "cod_tabela_programacao": ("avlHeader.jornada.codTabelaProgramacao", None),
    "viagem_sentido": ("avlHeader.viagem.sentido", None),
    "status_ignicao": ("avlHeader.sensores.statusIgnicao", None),
    "status_panico": ("avlHeader.sensores.statusPanico", None),
    "gps_array": ("avlHeader.gps", None),
    "id_ponto": ("avlEventoEntradaSaidaPonto.idPonto", "int"),
    "evento_ponto": ("avlEventoEntradaSaidaPonto.eventoPonto", None),
}
# fixed values: target column -> (point field, cast)
POINT_FIELDS = {
    "gps_timestamp_utc_geracao": ("timestampUtcGeracao", "bigint"),
    "gps_sinal": ("sinalGps", "string"),
    "latitude_raw": ("latitude", "double"),
    "longitude_raw": ("longitude", "double"),
    "velocidade": ("velocidade", "double"),
    "direcao": ("direcao", "double"),
    "numero_satelites": ("numeroSatelites", "int"),
    "hdop": ("hdop", "double"),
    "pdop": ("pdop", "double"),
    "odometro_calculado": ("odometroCalculado", "double"),
    "lat_erro": ("latErro", "double"),
    "lon_erro": ("lonErro", "double"),
}


def flatten_avl_header(messages: DataFrame) -> DataFrame:
    """Nested message -> 21 flat columns. A value that does not fit its type becomes NULL instead of failing the job."""
    flat = []
    for target, (path, kind) in HEADER_PATHS.items():
        source = F.col(".".join(f"`{step}`" for step in path.split(".")))
        flat.append((source.try_cast(kind) if kind else source).alias(target))
    return messages.select(*flat)


def explode_gps(flat: DataFrame) -> DataFrame:
    """One row per GPS point with its position; a message without points stays as one row with NULL index."""
    return flat.select("*", F.posexplode_outer("gps_array").alias("gps_idx", "gps_point"))


def normalize_time(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Epoch second, calendar day in ``zone`` and the two creation times as wall clock."""
    return rows.withColumns({
        "event_ts": F.col("event_ts_raw"),
        "event_dt": F.to_date(local_time(F.col("event_ts_raw"), zone)),
        "created_at_origem": instant_to_local(F.try_to_timestamp(F.col("created_at_origem_raw")), zone),
        "created_at_ingestao": instant_to_local(F.try_to_timestamp(F.col("created_at_ingestao_raw")), zone),
    })


def normalize_points(rows: DataFrame) -> DataFrame:
    """Typed point fields; coordinates in degrees next to the raw integers."""
    typed = rows.withColumns({
        target: F.col("gps_point").getField(field).try_cast(kind) for target, (field, kind) in POINT_FIELDS.items()
    })
    return typed.withColumns({
        "latitude": F.col("latitude_raw") / F.lit(COORDINATE_SCALE),
        "longitude": F.col("longitude_raw") / F.lit(COORDINATE_SCALE),
    })


def message_points(messages: DataFrame, zone: str = "UTC") -> DataFrame:
    """The whole chain; the nested columns are dropped so that nothing downstream carries the array."""
    return normalize_points(normalize_time(explode_gps(flatten_avl_header(messages)), zone)).drop(
        "gps_array", "gps_point", "event_ts_raw", "created_at_origem_raw", "created_at_ingestao_raw"
    )
