"""Fixed schemas, literals and column lists of the telemetry lake."""

from __future__ import annotations

# --- fixed values: message types, signal literal, coordinate scale, window length, fallback keys ----------------------
POSITION = "AVL_EVT_POSICIONAMENTO"
STOP_CALL = "AVL_EVT_ENTRADA_SAIDA_PONTO"
CARD_FARE = "AVL_EVT_PASSAGEM_CARTAO"
INVALID_SIGNAL = "AVL_QUALIDADE_SINAL_INVALIDO"
COORDINATE_SCALE = 360000.0
WINDOW_SECONDS = 300
MAX_HEADWAY_MIN = 180.0
MISSING_KEY = -1
MISSING_DIRECTION = "ND"

# --- fixed values: Bronze message (DDL, accepted by the JSON reader and by from_json) ---------------------------------
BRONZE_DDL = """
_id struct<`$oid`: string>,
timestamp bigint,
createdAt struct<`$date`: string>,
createdAtOrigem struct<`$date`: string>,
avlHeader struct<
    tipoMensagem: string,
    sequencial: bigint,
    dataHora: string,
    validador: struct<
        idEmpresa: bigint, codLinha: bigint, prefixoLinha: string,
        codVeiculo: bigint, prefixoVeiculo: string, codGaragem: bigint>,
    jornada: struct<codOperador: bigint, codTabelaProgramacao: string>,
    viagem: struct<sentido: string>,
    sensores: struct<statusIgnicao: string, statusPanico: string>,
    gps: array<struct<
        timestampUtcGeracao: bigint, sinalGps: string, latitude: double, longitude: double,
        velocidade: double, direcao: double, numeroSatelites: bigint, hdop: double, pdop: double,
        odometroCalculado: double, latErro: double, lonErro: double>>>,
avlEventoEntradaSaidaPonto struct<idPonto: bigint, eventoPonto: string>
"""

# --- fixed values: Silver column lists --------------------------------------------------------------------------------
HEADER_COLUMNS = [
    "event_id", "event_ts", "event_dt", "created_at_origem", "created_at_ingestao", "tipo_mensagem", "sequencial",
    "id_empresa", "cod_linha", "prefixo_linha", "cod_veiculo", "prefixo_veiculo", "cod_garagem", "cod_operador",
    "cod_tabela_programacao", "viagem_sentido", "status_ignicao", "status_panico",
]
POINT_COLUMNS = [
    "gps_idx", "gps_sinal", "latitude_raw", "longitude_raw", "latitude", "longitude", "velocidade", "direcao",
    "numero_satelites", "odometro_calculado",
]
SILVER_COLUMNS = {
    "gps_events": HEADER_COLUMNS + [
        "gps_idx", "gps_timestamp_utc_geracao", "gps_sinal", "latitude_raw", "longitude_raw", "latitude", "longitude",
        "velocidade", "direcao", "numero_satelites", "hdop", "pdop", "odometro_calculado", "lat_erro", "lon_erro",
    ],
    "stop_events": HEADER_COLUMNS + ["id_ponto", "evento_ponto"] + POINT_COLUMNS,
    "fare_events": HEADER_COLUMNS + POINT_COLUMNS,
    "operational_events": HEADER_COLUMNS + POINT_COLUMNS,
}
SILVER_TABLES = list(SILVER_COLUMNS)
SILVER_PARTITIONS = ["event_dt", "tipo_mensagem", "id_empresa"]
PREVIEW_COLUMNS = [
    "event_id", "tipo_mensagem", "event_ts", "event_dt", "id_empresa", "cod_linha", "cod_veiculo", "gps_idx",
    "gps_sinal", "latitude_raw", "longitude_raw", "latitude", "longitude", "velocidade", "id_ponto", "evento_ponto",
]

# --- fixed values: Gold -----------------------------------------------------------------------------------------------
VEHICLE_WINDOW = ["event_dt", "cod_linha", "cod_veiculo", "janela_5min"]
DIRECTION_WINDOW = ["event_dt", "cod_linha", "viagem_sentido", "janela_5min"]
CONTRACT_COLUMNS = VEHICLE_WINDOW + ["headway_observado_min", "headway_referencia_min", "atraso_aproximado_min"]
GOLD_COLUMNS = [
    "event_dt", "cod_linha", "cod_veiculo", "id_empresa", "viagem_sentido", "janela_5min", "latitude_media",
    "longitude_media", "velocidade_media", "gps_invalid_pct", "qtd_eventos_gps", "qtd_eventos_stop", "max_satelites",
    "headway_observado_min", "headway_referencia_min", "atraso_aproximado_min",
]
PREDICTION_COLUMNS = [
    "event_dt", "janela_5min", "cod_linha", "cod_veiculo", "faixa_horaria", "y_true", "y_pred",
]

# --- fixed values: semantic mapping -----------------------------------------------------------------------------------
TABLE_CLASS = {
    "gps_events": "tcc:EventoGPS",
    "stop_events": "tcc:EventoParada",
    "fare_events": "tcc:EventoTarifa",
    "operational_events": "tcc:EventoOperacional",
}
# (predicate, target class, source column, tables that map it)
OBJECT_LINKS = [
    ("tcc:temLinha", "tcc:Linha", "cod_linha", SILVER_TABLES),
    ("tcc:temVeiculo", "tcc:Veiculo", "cod_veiculo", SILVER_TABLES),
    ("tcc:temEmpresa", "tcc:Empresa", "id_empresa", SILVER_TABLES),
    ("tcc:temGaragem", "tcc:Garagem", "cod_garagem", ["gps_events"]),
    ("tcc:temJornadaProgramacao", "tcc:JornadaProgramacao", "cod_tabela_programacao", SILVER_TABLES),
    ("tcc:temTipoMensagem", "tcc:TipoMensagemAVL", "tipo_mensagem", SILVER_TABLES),
    ("tcc:ocorreNoPonto", "tcc:PontoParada", "id_ponto", ["stop_events"]),
]
# (source column, property, literal type); mapped for every table
DATA_PROPERTIES = [
    ("event_id", "tcc:eventId", "xsd:string"),
    ("event_ts", "tcc:eventTs", "xsd:long"),
    ("event_dt", "tcc:eventDate", "xsd:date"),
    ("gps_idx", "tcc:gpsIndex", "xsd:int"),
    ("gps_sinal", "tcc:gpsSinal", "xsd:string"),
    ("latitude", "tcc:latitude", "xsd:double"),
    ("longitude", "tcc:longitude", "xsd:double"),
    ("velocidade", "tcc:velocidade", "xsd:double"),
    ("viagem_sentido", "tcc:sentidoViagem", "xsd:string"),
]
# (rule id, code, priority)
SEMANTIC_RULES = [
    ("tcc:RegraFallbackChaves", "R_FALLBACK_KEYS_01", 1),
    ("tcc:RegraTimestampCanonico", "R_CANONICAL_TS_01", 2),
    ("tcc:RegraGPSInvalido", "R_GPS_INVALID_01", 3),
]

# --- fixed values: graph ----------------------------------------------------------------------------------------------
# node label -> name of its identifying property
GRAPH_NODE_KEYS = {
    "DecisionAggregateRun": "id",
    "FaixaHoraria": "hour",
    "LineHourMetric": "id",
    "CriticalSegment": "id",
    "Linha": "code",
    "Veiculo": "code",
}
DECISION_LABELS = ["DecisionAggregateRun", "LineHourMetric", "CriticalSegment", "FaixaHoraria"]
