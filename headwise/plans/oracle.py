"""The registered queries again, as DuckDB SQL written independently of the Spark code.

Row-level definitions are used throughout (row-wise ``lag``, ``row_number`` over everything, built-in ``median``), so that
the distributed formulations on the Spark side are checked against the plain meaning.
"""

from __future__ import annotations

import re

R = 9  # digits compared

CTES: dict[str, str] = {}

CTES["msg"] = """
select event_id as raw_id, cast(event_id as varchar) as event_id,
  1704067200 + (cast(floor(epoch(ts)) as bigint) - 1704067200) // 10 as event_ts,
  case when event_id % 1009 = 0 then null when event_type = 'view' then 'AVL_EVT_POSICIONAMENTO'
       when event_type in ('click', 'signup') then 'AVL_EVT_ENTRADA_SAIDA_PONTO'
       when event_type = 'purchase' then 'AVL_EVT_PASSAGEM_CARTAO'
       when event_id % 2 = 0 then 'AVL_EVT_RECARGA' else 'AVL_EVT_LIGA_DESLIGA' end as tipo_mensagem,
  event_id * 10 as sequencial,
  case when event_id % 211 = 0 then null else cast(user_id % 5 as int) end as id_empresa,
  case when event_id % 97 = 0 then null else cast(user_id % 3 as int) end as cod_linha,
  concat('L', cast(user_id % 3 as varchar)) as prefixo_linha,
  cast(user_id % 20 as int) as cod_veiculo,
  concat('V', cast(user_id % 20 as varchar)) as prefixo_veiculo,
  cast(user_id % 4 as int) as cod_garagem,
  case when event_id % 6 = 0 then null else user_id end as cod_operador,
  case when event_id % 9 = 0 then null else concat('T', cast(user_id % 7 as varchar)) end as cod_tabela_programacao,
  case when event_id % 5 = 0 then null when event_id % 2 = 0 then 'AVL_SENTIDO_IDA'
       else 'AVL_SENTIDO_VOLTA' end as viagem_sentido,
  case when event_id % 3 = 0 then 'LIGADA' else 'DESLIGADA' end as status_ignicao,
  case when event_id % 701 = 0 then 'ATIVO' else 'INATIVO' end as status_panico,
  case when event_type in ('click', 'signup') then cast(event_id % 50 as int) end as id_ponto,
  case when event_type = 'click' then 'ENTRADA' when event_type = 'signup' then 'SAIDA' end as evento_ponto,
  event_id % 4 as n_gps, value as valor
from events"""

CTES["msg_t"] = """
select *, cast(make_timestamp(event_ts * 1000000) as date) as event_dt,
  make_timestamp((event_ts + 2) * 1000000) as created_at_origem,
  make_timestamp((event_ts + 5) * 1000000) as created_at_ingestao
from msg"""

CTES["points"] = """
select m.*, cast(g.i as int) as gps_idx,
  make_timestamp((event_ts // 300) * 300 * 1000000) as janela_5min,
  event_ts - g.i as gps_timestamp_utc_geracao,
  case when g.i is null then null when (raw_id + g.i) % 4 = 0 then 'AVL_QUALIDADE_SINAL_INVALIDO'
       else 'AVL_QUALIDADE_SINAL_VALIDO' end as gps_sinal,
  case when g.i is null or (raw_id + g.i) % 11 = 0 then null when (raw_id + g.i) % 307 = 0 then cast(40000000 as double)
       else cast(-1350000 - (raw_id % 1000) * 10 - g.i as double) end as latitude_raw,
  case when g.i is null or (raw_id + g.i) % 13 = 0 then null
       else cast(-13860000 - (raw_id % 1000) * 10 - g.i as double) end as longitude_raw,
  case when g.i is null then null when raw_id % 401 = 0 then cast(-1 as double) else valor + g.i end as velocidade,
  case when g.i is null then null when raw_id % 503 = 0 then cast(400 as double)
       else cast((raw_id * 7 + g.i) % 361 as double) end as direcao,
  case when g.i is null then null else cast((raw_id + g.i) % 19 as int) end as numero_satelites,
  case when g.i is null then null when raw_id % 601 = 0 then cast('NaN' as double)
       else cast(raw_id % 50 as double) / cast(10 as double) end as hdop,
  case when g.i is null then null else cast(raw_id % 40 as double) / cast(10 as double) end as pdop,
  case when g.i is null then null else cast(raw_id * 100 + g.i as double) end as odometro_calculado,
  case when g.i is null then null else cast(raw_id % 7 as double) end as lat_erro,
  case when g.i is null then null else cast(raw_id % 5 as double) end as lon_erro
from msg_t m left join lateral (select unnest(range(0, n_gps)) as i) g on true"""

CTES["pts"] = """
select *, latitude_raw / 360000.0::double as latitude, longitude_raw / 360000.0::double as longitude from points"""

BAD = """(coalesce(gps_sinal = 'AVL_QUALIDADE_SINAL_INVALIDO', false) or latitude is null or longitude is null
  or coalesce(latitude not between -90 and 90, false) or coalesce(longitude not between -180 and 180, false))"""

HEADER = """event_id, event_ts, event_dt, created_at_origem, created_at_ingestao, tipo_mensagem, sequencial, id_empresa,
cod_linha, prefixo_linha, cod_veiculo, prefixo_veiculo, cod_garagem, cod_operador, cod_tabela_programacao,
viagem_sentido, status_ignicao, status_panico"""
POINT = """gps_idx, gps_sinal, latitude_raw, longitude_raw, latitude, longitude, velocidade, direcao, numero_satelites,
odometro_calculado"""

CTES["gps_events"] = f"""
select {HEADER}, {POINT}, gps_timestamp_utc_geracao, hdop, pdop, lat_erro, lon_erro from pts where gps_idx is not null"""
CTES["stop_events"] = f"""
select {HEADER}, id_ponto, evento_ponto, {POINT} from pts where tipo_mensagem = 'AVL_EVT_ENTRADA_SAIDA_PONTO'"""
CTES["fare_events"] = f"""
select {HEADER}, {POINT} from pts where tipo_mensagem = 'AVL_EVT_PASSAGEM_CARTAO'"""
CTES["operational_events"] = f"""
select {HEADER}, {POINT} from pts where tipo_mensagem not in
  ('AVL_EVT_POSICIONAMENTO', 'AVL_EVT_ENTRADA_SAIDA_PONTO', 'AVL_EVT_PASSAGEM_CARTAO')"""
CTES["tagged"] = """
select 'gps_events' as table_name, * from gps_events
union all by name select 'stop_events' as table_name, * from stop_events
union all by name select 'fare_events' as table_name, * from fare_events
union all by name select 'operational_events' as table_name, * from operational_events"""

CTES["stop_fb"] = """
select event_id, gps_idx, event_ts, event_dt, janela_5min, coalesce(cod_linha, -1) as cod_linha,
  coalesce(cod_veiculo, -1) as cod_veiculo, coalesce(viagem_sentido, 'ND') as viagem_sentido,
  viagem_sentido as sentido_raw
from pts where tipo_mensagem = 'AVL_EVT_ENTRADA_SAIDA_PONTO'"""
CTES["gaps"] = """
select *, (event_ts - lag(event_ts) over w) / 60.0::double as gap, lag(event_ts) over w as prev_event_ts
from stop_fb window w as (partition by event_dt, cod_linha, viagem_sentido order by event_ts, event_id, gps_idx)"""
CTES["observed"] = """
select event_dt, cod_linha, viagem_sentido, janela_5min, avg(gap) as headway_observado_min, count(*) as n_eventos_ponto,
  cast(hour(janela_5min) as int) as faixa_horaria
from gaps where gap > 0 and gap <= 180 group by all"""
CTES["reference"] = """
select cod_linha, viagem_sentido, faixa_horaria, quantile_disc(headway_observado_min, 0.5) as headway_referencia_min
from observed group by all"""
CTES["delay"] = """
select o.event_dt, o.cod_linha, o.viagem_sentido, o.janela_5min, headway_observado_min, headway_referencia_min,
  greatest(0.0::double, headway_observado_min - headway_referencia_min) as atraso_aproximado_min, n_eventos_ponto
from observed o join reference r using (cod_linha, viagem_sentido, faixa_horaria)"""
CTES["vehicle_ctx"] = f"""
select event_dt, coalesce(cod_linha, -1) as cod_linha, coalesce(cod_veiculo, -1) as cod_veiculo, janela_5min,
  coalesce(arg_min(id_empresa, row(event_ts, id_empresa)) filter (where id_empresa is not null), -1) as id_empresa,
  coalesce(arg_min(viagem_sentido, row(event_ts, viagem_sentido)) filter (where viagem_sentido is not null), 'ND')
    as viagem_sentido,
  avg(latitude) as latitude_media, avg(longitude) as longitude_media, avg(velocidade) as velocidade_media,
  avg(case when {BAD} then 1.0::double else 0.0::double end) as gps_invalid_pct,
  count(*) as qtd_eventos_gps, max(numero_satelites) as max_satelites
from pts where gps_idx is not null group by 1, 2, 3, 4"""
CTES["stop_win"] = """
select event_dt, cod_linha, cod_veiculo, janela_5min,
  coalesce(arg_min(sentido_raw, row(event_ts, sentido_raw)) filter (where sentido_raw is not null), 'ND')
    as viagem_sentido,
  count(*) as qtd_eventos_stop
from stop_fb group by 1, 2, 3, 4"""
CTES["base"] = """
select s.event_dt, s.cod_linha, s.cod_veiculo, s.janela_5min, s.viagem_sentido, s.qtd_eventos_stop,
  c.latitude_media, c.longitude_media, c.velocidade_media, c.gps_invalid_pct, c.qtd_eventos_gps, c.max_satelites,
  coalesce(c.id_empresa, -1) as id_empresa
from stop_win s left join vehicle_ctx c using (event_dt, cod_linha, cod_veiculo, janela_5min)"""
CTES["gold"] = """
select b.event_dt, b.cod_linha, b.cod_veiculo, b.id_empresa, b.viagem_sentido, b.janela_5min, b.latitude_media,
  b.longitude_media, b.velocidade_media, coalesce(b.gps_invalid_pct, 0.0::double) as gps_invalid_pct,
  coalesce(b.qtd_eventos_gps, 0) as qtd_eventos_gps, b.qtd_eventos_stop, b.max_satelites, d.headway_observado_min,
  d.headway_referencia_min, d.atraso_aproximado_min
from base b left join delay d using (event_dt, cod_linha, viagem_sentido, janela_5min)"""
CTES["unioned"] = f"""
select * exclude (id_empresa, cod_linha, cod_veiculo, table_name), coalesce(id_empresa, -1) as id_empresa,
  coalesce(cod_linha, -1) as cod_linha, coalesce(cod_veiculo, -1) as cod_veiculo, {BAD} as gps_is_invalid
from tagged"""

CTES["target"] = """
select * from (
  select event_dt, janela_5min, cod_linha, cod_veiculo, atraso_aproximado_min,
    cast(hour(janela_5min) as int) as faixa_horaria,
    lead(atraso_aproximado_min) over (partition by cod_linha, cod_veiculo order by janela_5min, event_dt) as y_true
  from gold where atraso_aproximado_min is not null)
where y_true is not null"""
CTES["positioned"] = """
select *, row_number() over (order by janela_5min, event_dt, cod_linha, cod_veiculo) - 1 as pos, count(*) over () as n
from target"""
CTES["labelled"] = """
select *, case when pos < cast(floor(n * 0.70::double) as bigint) then 'train'
               when pos < cast(floor(n * 0.85::double) as bigint) then 'val' else 'test' end as split
from positioned"""
CTES["train"] = "select * from labelled where split = 'train'"
CTES["test"] = "select * from labelled where split = 'test'"
CTES["med_lh"] = "select cod_linha, faixa_horaria, median(y_true) as m2 from train group by all"
CTES["med_l"] = "select cod_linha, median(y_true) as m1 from train group by all"
CTES["med_g"] = "select median(y_true) as m0 from train"
PRED = "event_dt, janela_5min, cod_linha, cod_veiculo, faixa_horaria, y_true, y_pred"
CTES["baseline"] = """
select t.event_dt, t.janela_5min, t.cod_linha, t.cod_veiculo, t.faixa_horaria, t.y_true,
  coalesce(m2, m1, (select m0 from med_g)) as y_pred
from test t left join med_lh using (cod_linha, faixa_horaria) left join med_l using (cod_linha)"""
CTES["model"] = """
select event_dt, janela_5min, cod_linha, cod_veiculo, faixa_horaria,
  case when (cast(epoch(janela_5min) as bigint) // 300 + cod_veiculo * 13 + cod_linha * 7) % 97 <> 0 then y_true end
    as y_true,
  0.8::double * y_true + 0.1::double * (cod_veiculo % 5) as y_pred
from test"""
for source in ("model", "baseline"):
    CTES[f"{source}_clean"] = f"""
select event_dt, janela_5min, cod_linha, cod_veiculo, faixa_horaria as hour, y_true, y_pred from {source}
where cod_linha is not null and cod_veiculo is not null and y_true is not null and y_pred is not null"""
    MEANS = """avg(y_pred) as pred_atraso_aproximado_min, avg(y_true) as real_atraso_aproximado_min,
  count(*) as n_registros"""
    CTES[f"{source}_lh"] = f"""
select '{source}' as prediction_source, cod_linha, hour, {MEANS} from {source}_clean group by 2, 3 having count(*) >= 2"""
    CTES[f"{source}_line"] = f"""
select cast(row_number() over (order by pred_atraso_aproximado_min desc, n_registros desc, cod_linha) as int) as rank, *
from (select '{source}' as prediction_source, cod_linha, {MEANS} from {source}_clean group by 2 having count(*) >= 3)"""
    CTES[f"{source}_hour"] = f"""
select cast(row_number() over (order by pred_atraso_aproximado_min desc, n_registros desc, hour) as int) as rank, *
from (select '{source}' as prediction_source, hour, {MEANS} from {source}_clean group by 2 having count(*) >= 2)"""
    CTES[f"{source}_seg"] = f"""
select '{source}' as prediction_source, cod_linha, hour, cod_veiculo, avg(abs(y_true - y_pred)) as mean_abs_error, {MEANS}
from {source}_clean group by 2, 3, 4 having count(*) >= 1"""
    CTES[f"{source}_vday"] = f"""
select event_dt, cod_veiculo, avg(y_pred) as avg_pred_atraso_aproximado_min, avg(y_true) as avg_real_atraso_aproximado_min,
  count(*) as n_registros from {source}_clean group by 1, 2"""
    CTES[f"{source}_veh"] = f"""
select cast(row_number() over (order by mean_abs_gap_pred_real desc, n_registros desc, cod_veiculo) as int) as rank, *
from (select '{source}' as prediction_source, cod_veiculo, avg(avg_pred_atraso_aproximado_min) as pred_atraso_aproximado_min,
        avg(avg_real_atraso_aproximado_min) as real_atraso_aproximado_min,
        avg(abs(avg_pred_atraso_aproximado_min - avg_real_atraso_aproximado_min)) as mean_abs_gap_pred_real,
        cast(sum(n_registros) as bigint) as n_registros, count(distinct event_dt) as n_dias
      from {source}_vday group by 2 having sum(n_registros) >= 3)"""
    CTES[f"{source}_top"] = f"""
(select 'line_ranking' as comparison_group, prediction_source, concat('cod_linha=', cod_linha) as top_key,
   pred_atraso_aproximado_min as top_value, n_registros as top_n_registros from {source}_line where rank = 1)
union all
(select 'hour_ranking', prediction_source, concat('hour=', hour), pred_atraso_aproximado_min, n_registros
   from {source}_hour where rank = 1)
union all
(select 'segment_error', prediction_source,
   concat('cod_linha=', cod_linha, '|hour=', hour, '|cod_veiculo=', cod_veiculo), mean_abs_error, n_registros
   from {source}_seg order by mean_abs_error desc, n_registros desc, cod_linha, hour, cod_veiculo limit 1)
union all
(select 'vehicle_instability', prediction_source, concat('cod_veiculo=', cod_veiculo), mean_abs_gap_pred_real, n_registros
   from {source}_veh where rank = 1)"""
CTES["judged_test"] = """
select event_dt, cod_linha, cod_veiculo, faixa_horaria as hour, y_true from test
where cod_linha is not null and cod_veiculo is not null and y_true is not null"""
CTES["lh_compare"] = """
select m.*, b.bp as baseline_pred_atraso_aproximado_min, b.br as baseline_real_atraso_aproximado_min,
  b.bn as baseline_n_registros, m.pred_atraso_aproximado_min - b.bp as pred_minus_baseline
from model_lh m left join (
  select cod_linha, hour, avg(y_pred) as bp, avg(y_true) as br, count(*) as bn from baseline_clean group by 1, 2) b
using (cod_linha, hour)"""
CTES["scored"] = """
select 'model' as model_name, y_true, y_pred from model union all select 'baseline', y_true, y_pred from baseline"""
CTES["line_sums"] = """
select avg(y_true) as my, avg(h) as mh, avg(m) as mm, covar_pop(h, h) as hh, covar_pop(m, m) as mm2, covar_pop(h, m) as hm,
  covar_pop(h, y_true) as hy, covar_pop(m, y_true) as m_y
from (select y_true, cast(hour(janela_5min) as double) as h, cast(minute(janela_5min) as double) as m from train)"""
CTES["fitted_line"] = """
select t.*, my + (mm2 * hy - hm * m_y) / (hh * mm2 - hm * hm) * (hour(janela_5min) - mh)
  + (hh * m_y - hm * hy) / (hh * mm2 - hm * hm) * (minute(janela_5min) - mm) as y_pred
from test t cross join line_sums"""
_FILLED = ["lag_1_velocidade_media", "lag_1_gps_invalid_pct", "lag_1_qtd_eventos_gps", "lag_1_qtd_eventos_stop",
           "lag_1_headway_referencia_min"]
CTES["constant"] = "select t.*, (select m0 from med_g) as y_pred from test t"

ERRORS = f"""round(avg(abs(y_true - y_pred)), {R}) as mae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), {R}) as rmse,
round(case when sum(abs(y_true)) < 1e-9 then 0.0::double else sum(abs(y_true - y_pred)) / sum(abs(y_true)) end, {R}) as wape,
round(median(abs(y_true - y_pred)), {R}) as medae,
round(avg(abs(y_true - y_pred) / case when abs(y_true) < 1e-9 then 1.0::double else abs(y_true) end) * 100.0::double, {R})
  as mape_secondary"""
VALID = "y_true is not null and y_pred is not null"


def r(*names: str) -> str:
    return ", ".join(f"round({n}, {R}) as {n}" for n in names)


MEAN3 = f"{r('pred_atraso_aproximado_min', 'real_atraso_aproximado_min')}, n_registros"
AVG3 = f"""round(avg(y_pred), {R}) as avg_pred_atraso_aproximado_min, round(avg(y_true), {R}) as avg_real_atraso_aproximado_min,
count(*) as n_registros"""
GOLD = f"""event_dt, cod_linha, cod_veiculo, id_empresa, viagem_sentido, janela_5min,
{r('latitude_media', 'longitude_media', 'velocidade_media', 'gps_invalid_pct')}, qtd_eventos_gps, qtd_eventos_stop,
max_satelites, {r('headway_observado_min', 'headway_referencia_min', 'atraso_aproximado_min')}"""
SILVER_GPS = f"{HEADER}, {POINT}, gps_timestamp_utc_geracao, hdop, pdop, lat_erro, lon_erro"


def pct(part: str, whole: str, name: str) -> str:
    return (f"round(case when {whole} > 0 then {part} / cast({whole} as double) * 100.0::double else 0.0::double end, {R}) "
            f"as {name}")


def count_if(test: str, name: str) -> str:
    return f"cast(count(*) filter (where {test}) as bigint) as {name}"


def duplicates(source: str) -> str:
    return f"""
select table_name, count(*) as rows_total, min(event_dt) as event_dt_min, max(event_dt) as event_dt_max,
  case when count(gps_idx) > 0 then 'event_id+gps_idx' else 'event_id' end as key_rule,
  cast(greatest(count(*) - case when count(gps_idx) > 0 then count(distinct row(event_id, gps_idx))
                           else count(distinct event_id) end, 0) as bigint) as duplicate_rows,
  case when count(*) > 0 then 'ok' else 'empty' end as status
from {source} group by table_name"""


CTES["tagged_dup"] = """
select * from tagged union all select * from tagged where cast(event_id as bigint) % 500 = 1"""
CTES["dq_a"] = duplicates("tagged_dup")
CTES["dq_b"] = f"""
select *, {pct('invalid_coord_pair_rows', 'coords_non_null_rows', 'pct_invalid_coord_pair')},
  case when invalid_coord_pair_rows = 0 then 'ok' else 'warning' end as status
from (select table_name, count(*) as rows_total, min(event_dt) as event_dt_min, max(event_dt) as event_dt_max,
  {count_if('latitude is not null and longitude is not null', 'coords_non_null_rows')},
  {count_if('latitude is null or longitude is null', 'coords_null_rows')},
  {count_if('latitude not between -90 and 90', 'invalid_lat_rows')},
  {count_if('longitude not between -180 and 180', 'invalid_lon_rows')},
  {count_if('latitude is not null and longitude is not null and (latitude not between -90 and 90 or '
            'longitude not between -180 and 180)', 'invalid_coord_pair_rows')}
  from tagged_dup group by table_name)"""

_INTS = ["id_empresa", "cod_linha", "cod_veiculo", "cod_garagem", "cod_operador", "gps_idx", "id_ponto",
         "numero_satelites"]
_NANS = ["latitude", "longitude", "velocidade", "direcao", "hdop", "pdop"]
_CHECKS = {f"invalid_{c}_rows": f"{c} < 0" for c in _INTS}
_CHECKS["invalid_direcao_range_rows"] = "direcao not between 0 and 360"
_CHECKS |= {f"invalid_{c}_negative_rows": f"{c} < 0" for c in ("velocidade", "odometro_calculado")}
_CHECKS |= {f"invalid_{c}_nan_rows": f"isnan({c})" for c in _NANS}
_ONLY = {"invalid_id_ponto_rows": "stop_events", "invalid_hdop_nan_rows": "gps_events", "invalid_pdop_nan_rows": "gps_events"}
_KEYS = ["cod_linha", "cod_veiculo", "cod_tabela_programacao", "viagem_sentido"]
CTES["dq_c"] = f"""
select *, case when invalid_numeric_total_rows = 0 then 'ok' else 'warning' end as status from (
  select * exclude ({', '.join(_ONLY)}),
    {', '.join(f"case when table_name = '{t}' then {c} end as {c}" for c, t in _ONLY.items())},
    {', '.join(pct(f'null_{k}_rows', 'rows_total', f'null_{k}_pct') for k in _KEYS)},
    cast({' + '.join(_CHECKS)} as bigint) as invalid_numeric_total_rows
  from (select table_name, count(*) as rows_total, min(event_dt) as event_dt_min, max(event_dt) as event_dt_max,
    {', '.join(count_if(f'{k} is null', f'null_{k}_rows') for k in _KEYS)},
    {', '.join(count_if(t, n) for n, t in _CHECKS.items())}
    from tagged_dup group by table_name))"""

CTES["msg_bad"] = """
select m.*, coalesce(b.bad, false) as bad from msg m left join (
  select raw_id, bool_or(gps_sinal = 'AVL_QUALIDADE_SINAL_INVALIDO' or latitude is null or longitude is null) as bad
  from pts where gps_idx is not null group by raw_id) b using (raw_id)"""

_LINKS = [("tcc:temLinha", "tcc:Linha", "cod_linha", None), ("tcc:temVeiculo", "tcc:Veiculo", "cod_veiculo", None),
          ("tcc:temEmpresa", "tcc:Empresa", "id_empresa", None),
          ("tcc:temGaragem", "tcc:Garagem", "cod_garagem", "gps_events"),
          ("tcc:temJornadaProgramacao", "tcc:JornadaProgramacao", "cod_tabela_programacao", None),
          ("tcc:temTipoMensagem", "tcc:TipoMensagemAVL", "tipo_mensagem", None),
          ("tcc:ocorreNoPonto", "tcc:PontoParada", "id_ponto", "stop_events")]
CTES["links"] = " union all ".join(
    f"select table_name, event_id, gps_idx, '{p}' as predicate, '{c}' as target_class, cast({col} as varchar) as object "
    f"from tagged where {col} is not null" + (f" and table_name = '{t}'" if t else "") for p, c, col, t in _LINKS)
_PROPS = [("event_id", "tcc:eventId", "xsd:string"), ("event_ts", "tcc:eventTs", "xsd:long"),
          ("event_dt", "tcc:eventDate", "xsd:date"), ("gps_idx", "tcc:gpsIndex", "xsd:int"),
          ("gps_sinal", "tcc:gpsSinal", "xsd:string"), ("latitude", "tcc:latitude", "xsd:double"),
          ("longitude", "tcc:longitude", "xsd:double"), ("velocidade", "tcc:velocidade", "xsd:double"),
          ("viagem_sentido", "tcc:sentidoViagem", "xsd:string")]
CTES["props"] = " union all ".join(
    f"select table_name, event_id, gps_idx, '{p}' as property, '{x}' as xsd, "
    + (f"cast(null as varchar) as literal_text, {c} as literal_double" if x == "xsd:double"
       else f"cast({c} as varchar) as literal_text, cast(null as double) as literal_double")
    + f" from tagged where {c} is not null" for c, p, x in _PROPS)

CTES["edges_all"] = """
select 'RANKS_LINE' as type, 'Linha' as dst_label, cast(cod_linha as varchar) as dst_id, rank from model_line
union all select 'RANKS_HOUR', 'FaixaHoraria', cast(hour as varchar), rank from model_hour
union all select 'RANKS_VEHICLE', 'Veiculo', cast(cod_veiculo as varchar), rank from model_veh"""
CTES["graph_nodes"] = """
select 'DecisionAggregateRun' as label, 'run_model' as id
union select 'Linha', cast(cod_linha as varchar) from model_line
union select 'Linha', cast(cod_linha as varchar) from lh_compare
union select 'Linha', cast(cod_linha as varchar) from model_seg
union select 'FaixaHoraria', cast(hour as varchar) from model_hour
union select 'FaixaHoraria', cast(hour as varchar) from lh_compare
union select 'FaixaHoraria', cast(hour as varchar) from model_seg
union select 'Veiculo', cast(cod_veiculo as varchar) from model_veh
union select 'Veiculo', cast(cod_veiculo as varchar) from model_seg
union select 'LineHourMetric', concat_ws('|', 'run_model', cod_linha, hour) from lh_compare
union select 'CriticalSegment', concat_ws('|', 'run_model', cod_linha, hour, cod_veiculo) from model_seg"""
SEG_ID = "concat_ws('|', 'run_model', cod_linha, hour, cod_veiculo)"
LH_ID = "concat_ws('|', 'run_model', cod_linha, hour)"

RANK_EDGE = "'DecisionAggregateRun' as src_label, 'run_model' as src_id"
LATEST = f"""n_registros as latest_n_registros, prediction_source as latest_prediction_source,
round(pred_atraso_aproximado_min, {R}) as latest_pred_atraso_aproximado_min,
round(real_atraso_aproximado_min, {R}) as latest_real_atraso_aproximado_min, 'run_model' as aggregate_run_id"""
HOUR_LABEL = "concat(hour, ':00-', hour, ':59')"

WIN = "(partition by cod_linha, cod_veiculo order by janela_5min, event_dt)"
_LAGGED = ["velocidade_media", "gps_invalid_pct", "qtd_eventos_gps", "qtd_eventos_stop", "headway_referencia_min",
           "headway_observado_min", "atraso_aproximado_min"]
CTES["line_roll"] = """
select cod_linha, event_dt, janela_5min, avg(v) over (partition by cod_linha order by janela_5min, event_dt
    rows between 3 preceding and 1 preceding) as roll_3_line_velocidade_media,
  avg(a) over (partition by cod_linha order by janela_5min, event_dt rows between 3 preceding and 1 preceding)
    as roll_3_line_atraso_aproximado_min
from (select cod_linha, event_dt, janela_5min, avg(velocidade_media) as v, avg(atraso_aproximado_min) as a
      from gold group by all)"""

TEMPORAL = """cast(hour(janela_5min) as int) as hour, cast(minute(janela_5min) as int) as minute,
cast(isodow(event_dt) - 1 as int) as day_of_week, isodow(event_dt) >= 6 as is_weekend"""


def metric_row(name: str, source: str) -> str:
    return f"""
select '{name}' as model_name, 'temporal_70_15_15' as split_strategy, 'next_window_same_line_vehicle' as prediction_horizon,
  (select count(*) from labelled) as row_count_total,
  (select count(*) from labelled where split = 'train') as row_count_train,
  (select count(*) from labelled where split = 'val') as row_count_val,
  (select count(*) from labelled where split = 'test') as row_count_test,
  {ERRORS}, round((select m0 from med_g), {R}) as global_baseline
from {source} where {VALID}"""


def index_sql(column: str) -> str:
    return f"""(select cast({column} as varchar) as k, row_number() over (order by count(*) desc, cast({column} as varchar)) - 1
  as i from gold_lab where split = 'train' group by 1)"""


CTES["odd_stops"] = """
select event_id, gps_idx, case when cast(event_id as bigint) % 11 <> 0 then event_dt end as event_dt,
  case cast(event_id as bigint) % 8 when 5 then null when 0 then 'A:B' when 1 then 'x y/z' when 2 then 'A=B' when 3 then '100%'
    when 4 then 'n\u00e3o' else tipo_mensagem end as tipo_mensagem, id_empresa from stop_events"""

CTES["gold_lab"] = """
select g.*, l.split, l.y_true from gold g join labelled l using (event_dt, janela_5min, cod_linha, cod_veiculo)"""

QUERIES: dict[str, str] = {
    # sources and sinks
    "bronze_json_scan": f"select {SILVER_GPS} from gps_events",
    "silver_scan_pruned": f"select {SILVER_GPS} from gps_events where event_dt between date '2024-01-02' and date '2024-01-02'",
    "gold_scan_subset": f"select event_dt, janela_5min, cod_linha, cod_veiculo, {r('atraso_aproximado_min')} from gold",
    "csv_roundtrip": f"select event_dt, janela_5min, cod_linha, cod_veiculo, faixa_horaria, {r('y_true', 'y_pred')} from model",
    "silver_write_readback": f"select {SILVER_GPS} from gps_events",
    "gold_write_readback": f"select {GOLD} from gold",
    "dq_report_union": f"""
select table_name, rows_total, event_dt_min, event_dt_max, key_rule, duplicate_rows, null as coords_null_rows,
  null as invalid_coord_pair_rows, status from dq_a
union all select table_name, rows_total, event_dt_min, event_dt_max, null, null, coords_null_rows, invalid_coord_pair_rows,
  status from dq_b""",
    "metrics_table": metric_row("baseline_median_future_by_line_timeband", "baseline"),
    "package_manifest": " union all ".join(
        f"select '{n}' as dataset_name, '{n}_run_model.csv' as file_name, count(*) as row_count from {c}" for n, c in {
            "line_hour_final": "model_lh", "line_ranking": "model_line", "hour_ranking": "model_hour",
            "segment_error": "model_seg", "vehicle_instability": "model_veh", "vehicle_day_ref": "model_vday",
            "line_hour_compare": "lh_compare",
            "line_hour_ref": "(select distinct cod_linha, hour from model_clean)"}.items()),
    # projections
    "flatten_header": f"""
select event_id, event_ts as event_ts_raw, strftime(created_at_origem, '%Y-%m-%dT%H:%M:%SZ') as created_at_origem_raw,
  strftime(created_at_ingestao, '%Y-%m-%dT%H:%M:%SZ') as created_at_ingestao_raw, tipo_mensagem, sequencial,
  strftime(make_timestamp(event_ts * 1000000), '%Y-%m-%d %H:%M:%S') as data_hora_header, id_empresa, cod_linha,
  prefixo_linha, cod_veiculo, prefixo_veiculo, cod_garagem, cod_operador, cod_tabela_programacao, viagem_sentido,
  status_ignicao, status_panico, cast(case when n_gps = 0 then null else n_gps end as int) as n_gps, id_ponto, evento_ponto
from msg_t""",
    "explode_gps": """
select event_id, tipo_mensagem, gps_idx, gps_timestamp_utc_geracao, gps_sinal, latitude_raw, longitude_raw from pts""",
    "normalize_time": "select event_id, gps_idx, event_ts, event_dt, created_at_origem, created_at_ingestao from pts",
    "normalize_coords": """
select event_id, gps_idx, gps_timestamp_utc_geracao, gps_sinal, latitude_raw, longitude_raw, latitude, longitude, velocidade,
  direcao, numero_satelites, hdop, pdop, odometro_calculado, lat_erro, lon_erro from pts""",
    "silver_gps_events": f"select {SILVER_GPS} from gps_events",
    "silver_stop_events": "select * from stop_events",
    "silver_fare_events": "select * from fare_events",
    "silver_operational_events": "select * from operational_events",
    "semantic_fallbacks": """
select event_id, gps_idx, coalesce(id_empresa, -1) as id_empresa, coalesce(cod_linha, -1) as cod_linha,
  coalesce(cod_veiculo, -1) as cod_veiculo, coalesce(viagem_sentido, 'ND') as viagem_sentido, cod_tabela_programacao
from pts""",
    "canonical_timestamp": """
select event_id, gps_idx, case when raw_id % 13 <> 0 then make_timestamp(event_ts * 1000000)
  when raw_id % 26 <> 0 then created_at_origem else created_at_ingestao end as canonical_ts
from pts""",
    "bronze_corrupt_lines": """
select count(*) as lines, count(*) filter (where event_id % 400 <> 3) as messages,
  count(*) filter (where event_id % 400 = 3) as corrupt_lines from events""",
    "silver_reingest": """
select event_id, gps_idx, event_dt,
  case when event_dt = date '2024-01-02' and cast(event_id as bigint) % 2 = 0 then 'AVL_EVT_CORRIGIDO' else tipo_mensagem end
    as tipo_mensagem,
  case when event_dt = date '2024-01-02' then 99 else id_empresa end as id_empresa from stop_events""",
    "silver_day_swap": """
select event_id, gps_idx, event_dt, tipo_mensagem, case when event_dt = date '2024-01-02' then 99 else id_empresa end as id_empresa
from odd_stops where event_dt is null or event_dt = date '2024-01-01'
  or (event_dt = date '2024-01-02' and cast(event_id as bigint) % 3 <> 0)""",
    "silver_stored_days": """
select distinct event_dt from odd_stops where event_dt in (date '2024-01-01', date '2024-01-02')""",
    "headway_gap_rows": """
select event_id, gps_idx, id_ponto, event_dt, cod_linha, viagem_sentido, event_ts,
  (event_ts - lag(event_ts) over w) / 60.0::double as headway_diff_min
from (select event_id, gps_idx, id_ponto, event_dt, coalesce(cod_linha, -1) as cod_linha,
        coalesce(viagem_sentido, 'ND') as viagem_sentido, event_ts from stop_events)
window w as (partition by event_dt, cod_linha, viagem_sentido order by event_ts, event_id, gps_idx nulls first)""",
    "gold_custom_contract": f"""
with ref1 as (select cod_linha, viagem_sentido, faixa_horaria, quantile_disc(headway_observado_min, 0.5) as ref
  from observed where event_dt <= date '2024-01-01' group by all)
select b.event_dt, b.cod_linha, b.cod_veiculo, b.id_empresa, b.viagem_sentido, b.janela_5min,
  {', '.join(f'round(b.{c}, {R}) as {c}' for c in ('latitude_media', 'longitude_media', 'velocidade_media'))},
  round(coalesce(b.gps_invalid_pct, 0.0::double), {R}) as gps_invalid_pct, coalesce(b.qtd_eventos_gps, 0) as qtd_eventos_gps,
  b.qtd_eventos_stop, b.max_satelites, round(o.headway_observado_min, {R}) as headway_observado_min,
  round(ref, {R}) as headway_referencia_min,
  round(case when ref is not null then greatest(0.0::double, o.headway_observado_min - ref) end, {R}) as atraso_aproximado_min
from base b left join observed o using (event_dt, cod_linha, viagem_sentido, janela_5min)
left join ref1 r on r.cod_linha = b.cod_linha and r.viagem_sentido = b.viagem_sentido and r.faixa_horaria = o.faixa_horaria
where minute(b.janela_5min) < 30""",
    "impute_median": f"""
with f as (select event_dt, janela_5min, cod_linha, cod_veiculo, split, {', '.join(f'l.{c}' for c in _FILLED)}
  from labelled join (select event_dt, janela_5min, cod_linha, cod_veiculo, {', '.join(
      f"cast(lag({c.removeprefix('lag_1_')}) over {WIN} as double) as {c}" for c in _FILLED)} from gold) l
  using (event_dt, janela_5min, cod_linha, cod_veiculo)),
m as (select {', '.join(f"median({c}) as {c}" for c in _FILLED)} from f where split = 'train')
select event_dt, janela_5min, cod_linha, cod_veiculo, split, {', '.join(
    f"round(coalesce(f.{c}, m.{c}, 0.0::double), {R}) as filled_{c}" for c in _FILLED)} from f, m""",
    "linear_two_features": f"""
select event_dt, janela_5min, cod_linha, cod_veiculo, faixa_horaria, round(y_true, {R}) as y_true, round(y_pred, 6) as y_pred
from fitted_line""",
    "fitted_line_ranking": f"""
select 'linear' as prediction_source, cod_linha, round(avg(y_pred), 6) as pred_atraso_aproximado_min,
  round(avg(y_true), {R}) as real_atraso_aproximado_min, count(*) as n_registros
from fitted_line group by 2 having count(*) >= 10""",
    "boosted_decisions": f"""
select 'line_hour_final' as data_set, concat(cod_linha, '|', hour) as key, round(avg(y_true), {R}) as real_atraso_aproximado_min,
  count(*) as n_registros from judged_test group by cod_linha, hour having count(*) >= 5
union all select 'line_hour_compare', concat(cod_linha, '|', hour), round(avg(y_true), {R}), count(*) from judged_test
  group by cod_linha, hour having count(*) >= 5
union all select 'line_ranking', cast(cod_linha as varchar), round(avg(y_true), {R}), count(*) from judged_test
  group by cod_linha having count(*) >= 10
union all select 'hour_ranking', cast(hour as varchar), round(avg(y_true), {R}), count(*) from judged_test
  group by hour having count(*) >= 5
union all select 'segment_error', concat(cod_linha, '|', hour, '|', cod_veiculo), round(avg(y_true), {R}), count(*) from judged_test
  group by cod_linha, hour, cod_veiculo having count(*) >= 5
union all select 'vehicle_instability', cast(cod_veiculo as varchar), round(avg(m), {R}), cast(sum(n) as bigint) from (
  select cod_veiculo, event_dt, avg(y_true) as m, count(*) as n from judged_test group by all)
  group by cod_veiculo having sum(n) >= 10""",
    "boosted_graph_edges": f"""
with line as (select cod_linha from judged_test group by all having count(*) >= 10),
h as (select hour from judged_test group by all having count(*) >= 5),
veh as (select cod_veiculo from judged_test group by all having count(*) >= 10),
lh as (select cod_linha, hour from judged_test group by all having count(*) >= 5),
seg as (select cod_linha, hour, cod_veiculo from judged_test group by all having count(*) >= 5)
select 'RANKS_LINE' as type, {RANK_EDGE}, 'Linha' as dst_label, cast(cod_linha as varchar) as dst_id from line
union all select 'RANKS_HOUR', {RANK_EDGE}, 'FaixaHoraria', cast(hour as varchar) from h
union all select 'RANKS_VEHICLE', {RANK_EDGE}, 'Veiculo', cast(cod_veiculo as varchar) from veh
union all select 'INCLUDES_LINE_HOUR', {RANK_EDGE}, 'LineHourMetric', {LH_ID} from lh
union all select 'HAS_LINE_HOUR_METRIC', 'Linha', cast(cod_linha as varchar), 'LineHourMetric', {LH_ID} from lh
union all select 'AT_HOUR', 'LineHourMetric', {LH_ID}, 'FaixaHoraria', cast(hour as varchar) from lh
union all select 'INCLUDES_SEGMENT', {RANK_EDGE}, 'CriticalSegment', {SEG_ID} from seg
union all select 'OF_LINE', 'CriticalSegment', {SEG_ID}, 'Linha', cast(cod_linha as varchar) from seg
union all select 'OF_VEHICLE', 'CriticalSegment', {SEG_ID}, 'Veiculo', cast(cod_veiculo as varchar) from seg
union all select 'AT_HOUR', 'CriticalSegment', {SEG_ID}, 'FaixaHoraria', cast(hour as varchar) from seg""",
    "model_keys": " union all ".join(
        f"select '{k}' as kind, event_dt, janela_5min, cod_linha, cod_veiculo, round(y_true, {R}) as y_true from test"
        for k in ("linear", "gbt", "rf")),
    "bucket_5min": "select event_id, gps_idx, janela_5min from pts",
    "gps_invalid_flag": f"select event_id, gps_idx, gps_sinal, latitude, longitude, {BAD} as gps_is_invalid from pts",
    "contract_table": """
select event_dt, cod_linha, cod_veiculo, make_timestamp((event_ts // 300) * 300 * 1000000) as janela_5min,
  cast(null as double) as headway_observado_min, cast(null as double) as headway_referencia_min,
  cast(null as double) as atraso_aproximado_min
from unioned""",
    "ensure_hour": f"""
select cod_linha, cod_veiculo, janela_5min, cast(hour(janela_5min) as int) as hour, {r('atraso_aproximado_min')} from gold""",
    # filters
    "date_range_filter": f"select {SILVER_GPS} from gps_events where event_dt >= date '2024-01-02'",
    "clean_predictions": f"""
select event_dt, janela_5min, cod_linha, cod_veiculo, hour, {r('y_true', 'y_pred')} from model_clean""",
    "dropped_predictions": f"""
select count(*) as rows_total, {count_if('y_true is null or y_pred is null', 'rows_dropped')} from model""",
    # joins
    "headway_delay": f"""
select event_dt, cod_linha, viagem_sentido, janela_5min,
  {r('headway_observado_min', 'headway_referencia_min', 'atraso_aproximado_min')}, n_eventos_ponto from delay""",
    "gold_semi_keys": "select * from stop_win",
    "gold_vehicle_join": f"""
select event_dt, cod_linha, cod_veiculo, janela_5min, viagem_sentido, qtd_eventos_stop, id_empresa,
  {r('latitude_media', 'longitude_media', 'velocidade_media', 'gps_invalid_pct')}, qtd_eventos_gps, max_satelites from base""",
    "gold_final_table": f"select {GOLD} from gold",
    "baseline_predict": f"select event_dt, janela_5min, cod_linha, cod_veiculo, faixa_horaria, {r('y_true', 'y_pred')} from baseline",
    "line_hour_compare": f"""
select prediction_source, cod_linha, hour, {MEAN3}, {r('baseline_pred_atraso_aproximado_min',
  'baseline_real_atraso_aproximado_min')}, baseline_n_registros, {r('pred_minus_baseline')} from lh_compare""",
    "event_alignment": """
select event_id, gps_idx, """ + ", ".join(
        f"{t}.{c} as {t}_{c}" for t in ("gps", "stop", "fare", "operational")
        for c in ("event_dt", "event_ts", "cod_linha", "cod_veiculo")) + ", " + ", ".join(
        f"cast(case when {t}.event_ts is null then 0 else 1 end as bigint) as {t}_rows"
        for t in ("gps", "stop", "fare", "operational")) + """
from gps_events gps full join stop_events stop using (event_id, gps_idx)
full join fare_events fare using (event_id, gps_idx) full join operational_events operational using (event_id, gps_idx)""",
    "baseline_two_level": f"""
select t.event_dt, t.janela_5min, t.cod_linha, t.cod_veiculo, t.faixa_horaria, {r('y_true')},
  round(coalesce(m2, (select m0 from med_g)), {R}) as y_pred
from test t left join med_lh using (cod_linha, faixa_horaria)""",
    "baseline_contemporaneous": f"""
select event_dt, janela_5min, cod_linha, cod_veiculo, cast(hour(janela_5min) as int) as faixa_horaria,
  round(atraso_aproximado_min, {R}) as y_true,
  round(median(atraso_aproximado_min) over (partition by cod_linha, hour(janela_5min)), {R}) as y_pred
from gold where atraso_aproximado_min is not null""",
    # aggregates
    "vehicle_window_context": f"""
select event_dt, cod_linha, cod_veiculo, janela_5min, id_empresa, viagem_sentido,
  {r('latitude_media', 'longitude_media', 'velocidade_media', 'gps_invalid_pct')}, qtd_eventos_gps, max_satelites
from vehicle_ctx""",
    "stop_vehicle_windows": "select * from stop_win",
    "headway_observed": f"""
select event_dt, cod_linha, viagem_sentido, janela_5min, {r('headway_observado_min')}, n_eventos_ponto, faixa_horaria
from observed""",
    "headway_reference": f"select cod_linha, viagem_sentido, faixa_horaria, {r('headway_referencia_min')} from reference",
    "silver_validation": """
select 'gps_events' as table_name, count(*) as rows, min(event_ts) as min_ts, max(event_ts) as max_ts,
  count(distinct event_id) as distinct_event_id, null::bigint as distinct_id_ponto, null::bigint as distinct_cod_linha,
  null::bigint as distinct_cod_veiculo from gps_events
union all select 'stop_events', count(*), min(event_ts), max(event_ts), count(distinct event_id), count(distinct id_ponto),
  null, null from stop_events
union all select 'fare_events', count(*), min(event_ts), max(event_ts), count(distinct event_id), null,
  count(distinct cod_linha), count(distinct cod_veiculo) from fare_events
union all select 'operational_events', count(*), min(event_ts), max(event_ts), null, null, null, null
  from operational_events""",
    "dq_duplicates": "select * from dq_a",
    "dq_duplicates_by_day": "select * from dq_a",
    "dq_coordinates": "select * from dq_b",
    "dq_nulls_types": "select * from dq_c",
    "dq_summary": f"""
select a.* exclude (status), a.status as status_a, coords_non_null_rows, coords_null_rows, invalid_coord_pair_rows,
  pct_invalid_coord_pair, b.status as status_b, {', '.join(f'null_{k}_pct' for k in _KEYS)}, invalid_numeric_total_rows,
  c.status as status_c,
  case when a.status = 'ok' and b.status = 'ok' and c.status = 'ok' then 'ok' else 'warning' end as status_overall
from dq_a a join dq_b b using (table_name) join dq_c c using (table_name)""",
    "raw_profile": f"""
select count(*) as total_records, min(event_ts) as min_timestamp, max(event_ts) as max_timestamp,
  count(distinct cod_linha) as approx_distinct_cod_linha, count(distinct cod_veiculo) as approx_distinct_cod_veiculo,
  count(distinct id_empresa) as approx_distinct_id_empresa, {count_if('cod_operador is null', 'null_cod_operador')},
  {count_if('viagem_sentido is null', 'null_viagem_sentido')}, {count_if('bad', 'records_with_invalid_gps')}
from msg_bad""",
    "raw_profile_by_type": "select tipo_mensagem, count(*) as records, " + ", ".join(
        f"round(avg(case when {t} then 1.0::double else 0.0::double end) * 100.0::double, {R}) as {n}" for n, t in {
            "pct_invalid_gps": "bad", "pct_null_cod_linha": "cod_linha is null",
            "pct_null_cod_veiculo": "cod_veiculo is null", "pct_null_cod_operador": "cod_operador is null",
            "pct_null_viagem_sentido": "viagem_sentido is null", "pct_with_gps_array": "n_gps > 0"}.items())
        + " from msg_bad group by 1",
    "pred_line_hour": f"select prediction_source, cod_linha, hour, {MEAN3} from model_lh",
    "line_ranking": f"select rank, prediction_source, cod_linha, {MEAN3} from model_line",
    "hour_ranking": f"select rank, prediction_source, hour, {MEAN3} from model_hour",
    "segment_errors": f"select prediction_source, cod_linha, hour, cod_veiculo, {r('mean_abs_error')}, {MEAN3} from model_seg",
    "vehicle_instability": f"""
select rank, prediction_source, cod_veiculo, {MEAN3}, {r('mean_abs_gap_pred_real')}, n_dias from model_veh""",
    "line_hour_metrics": f"""
select cod_linha, cast(hour(janela_5min) as int) as faixa_horaria, {AVG3} from baseline group by 1, 2""",
    "line_datehour_metrics": f"""
select cod_linha, cast(date_trunc('hour', janela_5min) as timestamp) as data_hora, {AVG3} from baseline group by 1, 2""",
    "vehicle_day_metrics": f"select event_dt, cod_veiculo, {AVG3} from baseline group by 1, 2",
    "error_metrics": f"""
select model_name, count(*) as n_registros, {ERRORS} from scored where {VALID} group by 1""",
    "prediction_audit": f"""
select a.*, mae, rmse, medae, wape from (
  select model_name, count(*) as rows_total, {count_if(VALID, 'rows_valid')}, {count_if('y_true is null', 'null_y_true')},
    {count_if('y_pred is null', 'null_y_pred')},
    case when count(*) = count(*) filter (where {VALID}) then 'valid' else 'invalid_predictions' end as status
  from scored group by 1) a
left join (select model_name, {ERRORS} from scored where {VALID} group by 1) m using (model_name)""",
    "target_zero_mass": f"""
select count(*) as n_registros, round(avg(case when y_true = 0 then 1.0::double else 0.0::double end), {R}) as share_zero,
  round(avg(case when abs(y_true) <= 0.1 then 1.0::double else 0.0::double end), {R}) as share_le_0_1 from test""",
    "gold_validation": f"""
select count(*) as row_count, {count_if('atraso_aproximado_min is null', 'null_target')},
  count(atraso_aproximado_min) as non_null_target,
  round((count(*) - count(atraso_aproximado_min)) / cast(count(*) as double) * 100.0::double, {R}) as null_target_pct,
  case when (count(*) - count(atraso_aproximado_min)) / cast(count(*) as double) * 100 <= 10 then 'ok' else 'warning' end
    as target_quality_status
from gold""",
    "contract_validation": f"""
select count(*) as rows_total, {count_if('event_dt is null', 'null_event_dt_rows')},
  {count_if('cod_linha is null', 'null_cod_linha_rows')}, {count_if('cod_veiculo is null', 'null_cod_veiculo_rows')},
  cast(0 as bigint) as coord_out_of_range_rows, 'ok' as status from unioned""",
    "top_summary": f"select comparison_group, prediction_source, top_key, {r('top_value')}, top_n_registros from model_top",
    "top_compare": f"""
select comparison_group, o.prediction_source as old_source, o.top_key as old_key, round(o.top_value, {R}) as old_value,
  o.top_n_registros as old_n_registros, n.prediction_source as new_source, n.top_key as new_key,
  round(n.top_value, {R}) as new_value, n.top_n_registros as new_n_registros
from baseline_top o full join model_top n using (comparison_group)""",
    "actual_delay_means": f"""
with known as (select *, cast(hour(janela_5min) as int) as faixa_horaria from gold where atraso_aproximado_min is not null)
select 'mean_line_hour' as summary, cod_linha, faixa_horaria, null::int as cod_veiculo, null::date as event_dt,
  round(avg(atraso_aproximado_min), {R}) as value from known group by 2, 3
union all select 'mean_vehicle_day', null, null, cod_veiculo, event_dt, round(avg(atraso_aproximado_min), {R})
  from known group by 4, 5
union all select 'median_line', cod_linha, null, null, null, round(median(atraso_aproximado_min), {R}) from known group by 2""",
    # windows
    "headway_gaps": f"""
select g.event_dt, g.cod_linha, g.viagem_sentido, g.event_ts, c.rows_at_second, prev_event_ts, round(gap, {R}) as headway_diff_min
from gaps g join (select event_dt, cod_linha, viagem_sentido, event_ts, count(*) as rows_at_second from stop_fb group by all) c
using (event_dt, cod_linha, viagem_sentido, event_ts) where gap is null or gap > 0""",
    "target_next_window": f"""
select event_dt, janela_5min, cod_linha, cod_veiculo, faixa_horaria, {r('atraso_aproximado_min', 'y_true')} from target""",
    "target_next_row": f"""
select * from (select event_dt, janela_5min, cod_linha, cod_veiculo, cast(hour(janela_5min) as int) as faixa_horaria,
    {r('atraso_aproximado_min')}, round(lead(atraso_aproximado_min) over {WIN}, {R}) as y_true from gold)
where y_true is not null""",
    "lag_features": f"""
select event_dt, janela_5min, cod_linha, cod_veiculo, """ + ", ".join(
        (f"lag({c}) over {WIN} as lag_1_{c}" if c.startswith("qtd") else f"round(lag({c}) over {WIN}, {R}) as lag_1_{c}")
        for c in _LAGGED) + " from gold",
    "rolling_features": f"""
select event_dt, janela_5min, cod_linha, cod_veiculo,
  round(avg(velocidade_media) over w, {R}) as roll_3_vehicle_velocidade_media,
  round(avg(atraso_aproximado_min) over w, {R}) as roll_3_vehicle_atraso_aproximado_min,
  {r('roll_3_line_velocidade_media', 'roll_3_line_atraso_aproximado_min')}
from gold left join line_roll using (cod_linha, event_dt, janela_5min)
window w as (partition by cod_linha, cod_veiculo order by janela_5min, event_dt rows between 3 preceding and 1 preceding)""",
    "temporal_split": f"""
select event_dt, janela_5min, cod_linha, cod_veiculo, {r('y_true')}, split from labelled""",
    "split_sizes": f"""
select count(*) as row_count_total, """ + ", ".join(
        count_if(f"split = '{s}'", f"row_count_{s}") for s in ("train", "val", "test")) + " from labelled",
    "silver_days": "select distinct event_dt from gps_events where event_dt is not null",
    "union_events": f"select {HEADER}, {POINT}, gps_is_invalid from unioned",
    # features and baselines
    "temporal_features": f"select event_dt, janela_5min, cod_linha, cod_veiculo, {TEMPORAL} from gold",
    "baseline_global": f"""
select event_dt, janela_5min, cod_linha, cod_veiculo, faixa_horaria, {r('y_true', 'y_pred')} from constant""",
    "predictions": f"""
select 'baseline_median_future_by_line_timeband' as model_name, event_dt, janela_5min, cod_linha, cod_veiculo, faixa_horaria,
  {r('y_true', 'y_pred')} from baseline""",
    "model_comparison": f"""
select 'baseline_three_level' as model_name, count(*) as n_registros, {ERRORS} from baseline where {VALID}
union all select 'constant_median', count(*), {ERRORS} from constant where {VALID}""",
    "impute_mean": f"""
select event_dt, janela_5min, cod_linha, cod_veiculo, coalesce(viagem_sentido, 'Unknown') as viagem_sentido, """ + ", ".join(
        f"round(coalesce({c}, (select avg({c}) from gold)), {R}) as filled_{c}" for c in (
            "velocidade_media", "latitude_media", "headway_observado_min", "atraso_aproximado_min")) + " from gold",
    "target_mean_codes": f"""
with b as (
  select *, (hour(janela_5min) * 12 + minute(janela_5min) // 5 + cod_veiculo) % 5 as fold from gold_lab),
m as (select avg(y_true) as m from b where split = 'train'),
l as (select cod_linha, fold, sum(y_true) as s, count(*) as n from b where split = 'train' group by all),
v as (select cod_veiculo, fold, sum(y_true) as s, count(*) as n from b where split = 'train' group by all)
select event_dt, janela_5min, cod_linha, cod_veiculo, split,
  round((coalesce((select sum(s) from l where l.cod_linha = b.cod_linha and (b.split <> 'train' or l.fold <> b.fold)), 0) + m)
    / (coalesce((select sum(n) from l where l.cod_linha = b.cod_linha and (b.split <> 'train' or l.fold <> b.fold)), 0) + 1.0::double), {R})
    as cod_linha_mean,
  round((coalesce((select sum(s) from v where v.cod_veiculo = b.cod_veiculo and (b.split <> 'train' or v.fold <> b.fold)), 0) + m)
    / (coalesce((select sum(n) from v where v.cod_veiculo = b.cod_veiculo and (b.split <> 'train' or v.fold <> b.fold)), 0) + 1.0::double), {R})
    as cod_veiculo_mean
from b, m""",
    "encode_categories": f"""
select event_dt, janela_5min, cod_linha, cod_veiculo, viagem_sentido,
  cast(coalesce(a.i, (select count(*) from {index_sql('cod_linha')} q)) as double) as cod_linha_index,
  cast(coalesce(b.i, (select count(*) from {index_sql('viagem_sentido')} q)) as double) as viagem_sentido_index
from gold_lab left join {index_sql('cod_linha')} a on a.k = cast(cod_linha as varchar)
left join {index_sql('viagem_sentido')} b on b.k = viagem_sentido""",
    # graph
    "graph_rank_line": f"""
select 'RANKS_LINE' as type, {RANK_EDGE}, 'Linha' as dst_label, cast(cod_linha as varchar) as dst_id, rank,
  prediction_source, {MEAN3} from model_line""",
    "graph_rank_line_nodes": f"""
select 'Linha' as label, cast(cod_linha as varchar) as id, cod_linha as code, rank as latest_line_rank, {LATEST}
from model_line""",
    "graph_rank_hour": f"""
select 'RANKS_HOUR' as type, {RANK_EDGE}, 'FaixaHoraria' as dst_label, cast(hour as varchar) as dst_id, rank,
  prediction_source, {MEAN3} from model_hour""",
    "graph_rank_hour_nodes": f"""
select 'FaixaHoraria' as label, cast(hour as varchar) as id, hour, {HOUR_LABEL} as hour_label, rank as latest_hour_rank,
  {LATEST} from model_hour""",
    "graph_rank_vehicle": f"""
select 'RANKS_VEHICLE' as type, {RANK_EDGE}, 'Veiculo' as dst_label, cast(cod_veiculo as varchar) as dst_id, rank,
  prediction_source, {MEAN3}, {r('mean_abs_gap_pred_real')}, n_dias from model_veh""",
    "graph_rank_vehicle_nodes": f"""
select 'Veiculo' as label, cast(cod_veiculo as varchar) as id, cod_veiculo as code, rank as latest_vehicle_rank, {LATEST},
  round(mean_abs_gap_pred_real, {R}) as latest_mean_abs_gap_pred_real from model_veh""",
    "graph_line_hour": f"""
select 'INCLUDES_LINE_HOUR' as type, {RANK_EDGE}, 'LineHourMetric' as dst_label, {LH_ID} as dst_id from lh_compare
union all select 'HAS_LINE_HOUR_METRIC', 'Linha', cast(cod_linha as varchar), 'LineHourMetric', {LH_ID} from lh_compare
union all select 'AT_HOUR', 'LineHourMetric', {LH_ID}, 'FaixaHoraria', cast(hour as varchar) from lh_compare""",
    "graph_line_hour_nodes": f"""
select 'LineHourMetric' as label, {LH_ID} as id, prediction_source, {MEAN3},
  {r('baseline_pred_atraso_aproximado_min', 'baseline_real_atraso_aproximado_min')}, baseline_n_registros,
  {r('pred_minus_baseline')}, 'run_model' as aggregate_run_id from lh_compare""",
    "graph_segments": f"""
select 'INCLUDES_SEGMENT' as type, {RANK_EDGE}, 'CriticalSegment' as dst_label, {SEG_ID} as dst_id from model_seg
union all select 'OF_LINE', 'CriticalSegment', {SEG_ID}, 'Linha', cast(cod_linha as varchar) from model_seg
union all select 'OF_VEHICLE', 'CriticalSegment', {SEG_ID}, 'Veiculo', cast(cod_veiculo as varchar) from model_seg
union all select 'AT_HOUR', 'CriticalSegment', {SEG_ID}, 'FaixaHoraria', cast(hour as varchar) from model_seg""",
    "graph_segments_nodes": f"""
select 'CriticalSegment' as label, {SEG_ID} as id, prediction_source, {r('mean_abs_error')}, {MEAN3},
  'run_model' as aggregate_run_id from model_seg""",
    "graph_upsert": f"""
select 'Linha' as label, cast(coalesce(n.cod_linha, o.cod_linha) as varchar) as id, coalesce(n.cod_linha, o.cod_linha) as code,
  coalesce(n.rank, o.rank) as latest_line_rank, coalesce(n.n_registros, o.n_registros) as latest_n_registros,
  coalesce(n.prediction_source, o.prediction_source) as latest_prediction_source,
  round(coalesce(n.pred_atraso_aproximado_min, o.pred_atraso_aproximado_min), {R}) as latest_pred_atraso_aproximado_min,
  round(coalesce(n.real_atraso_aproximado_min, o.real_atraso_aproximado_min), {R}) as latest_real_atraso_aproximado_min,
  case when n.rank is null then 'run_baseline' else 'run_model' end as aggregate_run_id
from baseline_line o full join model_line n on o.cod_linha = n.cod_linha""",
    "graph_purge": """
select g.label, g.id, l.rank as latest_line_rank, v.rank as latest_vehicle_rank from graph_nodes g
left join model_line l on g.label = 'Linha' and g.id = cast(l.cod_linha as varchar)
left join model_veh v on g.label = 'Veiculo' and g.id = cast(v.cod_veiculo as varchar)
where g.label in ('Linha', 'Veiculo')""",
    "graph_unique_violations": """
select label, count(*) as nodes, count(distinct id) as distinct_ids, count(distinct id) filter (where copies > 1) as violations
from (select label, id, count(*) over (partition by label, id) as copies from (
  select 'Linha' as label, cast(cod_linha as varchar) as id from model_line
  union all select 'Linha', cast(cod_linha as varchar) from baseline_line))
group by 1""",
    "gq_top_lines": f"select cod_linha, rank, {MEAN3} from model_line order by rank limit 10",
    "gq_top_hours": f"select hour, rank, {MEAN3} from model_hour order by rank limit 10",
    "gq_top_vehicles": f"""
select cod_veiculo, rank, {r('mean_abs_gap_pred_real')}, {MEAN3} from model_veh where rank <= 10""",
    "gq_gap_vs_baseline": f"""
select cod_linha, hour, {r('pred_atraso_aproximado_min', 'baseline_pred_atraso_aproximado_min', 'pred_minus_baseline')},
  n_registros from (select * from lh_compare
    order by lh_compare.pred_minus_baseline desc nulls first, cod_linha, hour limit 10) t""",
    "gq_overview": "select type, 'run_model' as run_id, dst_label, dst_id, rank from edges_all where rank <= 5",
    "gq_line_focus": f"""
select cast(s.cod_linha as varchar) as line_id, l.rank as line_rank, segment_id, round(s.mean_abs_error, {R}) as mean_abs_error,
  cast(s.cod_veiculo as varchar) as vehicle_id
from (select *, {SEG_ID} as segment_id from model_seg) s join model_line l using (cod_linha) where l.rank = 1
order by s.mean_abs_error desc, segment_id limit 6""",
    "gq_segment_focus": f"""
select segment_id, round(s.mean_abs_error, {R}) as mean_abs_error, n_registros, cast(cod_linha as varchar) as line_id,
  cast(cod_veiculo as varchar) as vehicle_id, cast(hour as varchar) as hour_id
from (select *, {SEG_ID} as segment_id from model_seg) s order by s.mean_abs_error desc, segment_id limit 1""",
    # semantic layer
    "semantic_links": "select * from links",
    "semantic_properties": f"""
select table_name, event_id, gps_idx, property, xsd, literal_text, {r('literal_double')} from props""",
    "semantic_entities": "select target_class, object, count(*) as n_links from links group by all",
    "semantic_summary": """
select (select count(distinct target_class) from links) + (select count(distinct table_name) from tagged) as classes,
  (select count(distinct predicate) from links) + (select count(distinct property) from props) as properties,
  cast(3 as bigint) as rules, (select count(distinct table_name) from tagged) as silver_tables""",
    "semantic_table_class": """
select table_name as silver_table, case table_name when 'gps_events' then 'tcc:EventoGPS' when 'stop_events' then
  'tcc:EventoParada' when 'fare_events' then 'tcc:EventoTarifa' when 'operational_events' then 'tcc:EventoOperacional' end
  as semantic_class, count(*) as n_rows from tagged group by 1, 2""",
    "semantic_rule_hits": f"""
select 'tcc:RegraFallbackChaves' as rule_id, 'R_FALLBACK_KEYS_01' as code, 1 as priority, count(*) as rows_checked,
  {count_if('id_empresa is null or cod_linha is null or cod_veiculo is null', 'rows_touched')} from pts
union all select 'tcc:RegraTimestampCanonico', 'R_CANONICAL_TS_01', 2, count(*), {count_if('cast(event_id as bigint) % 13 = 0', 'x')} from pts
union all select 'tcc:RegraGPSInvalido', 'R_GPS_INVALID_01', 3, count(*), {count_if(BAD, 'x')} from pts""",
}


def _used(sql: str) -> list[str]:
    return [name for name in CTES if re.search(rf"\b(?:from|join)\s+{name}\b", sql)]


def full_sql(body: str) -> str:
    """Prefix a query with the common table expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in _used(sql):
            if name not in order:
                visit(CTES[name])
                order.append(name)

    visit(body)
    ctes = ",\n".join(f"{name} as materialized ({CTES[name]})" for name in order)
    if not order:
        return body
    stripped = body.strip()
    if stripped.startswith("with "):
        return f"with {ctes},\n{stripped[len('with '):]}"
    return f"with {ctes}\n{stripped}"


def all_sql() -> dict[str, str]:
    return {name: full_sql(body) for name, body in QUERIES.items()}
