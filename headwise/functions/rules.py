"""The three semantic rules: fallback keys, canonical timestamp, invalid GPS flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.functions.clock import local_time, window_start
from headwise.schemas import INVALID_SIGNAL, MISSING_DIRECTION, MISSING_KEY


def or_missing(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(MISSING_KEY))


def direction_or_nd(column: str = "viagem_sentido") -> Column:
    return F.coalesce(F.col(column), F.lit(MISSING_DIRECTION))


def outside(column: str, limit: float) -> Column:
    """True when a value lies outside [-limit, limit]; NULL for NULL."""
    return ~F.col(column).between(-limit, limit)


def gps_is_invalid(signal: str = "gps_sinal", lat: str = "latitude", lon: str = "longitude") -> Column:
    """Written rule, two-valued: bad signal, or a missing coordinate, or one out of range. Never NULL.

    NULL parts count as "not proven bad" except for the coordinates, whose absence is itself a defect. Rows are flagged,
    never dropped.
    """
    def sure(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    return (
        sure(F.col(signal) == INVALID_SIGNAL)
        | F.col(lat).isNull()
        | F.col(lon).isNull()
        | sure(outside(lat, 90.0))
        | sure(outside(lon, 180.0))
    )


def canonical_timestamp(zone: str = "UTC") -> Column:
    """Event time, else creation at the device, else ingestion."""
    return F.coalesce(local_time(F.col("event_ts"), zone), F.col("created_at_origem"), F.col("created_at_ingestao"))


def with_fallback_keys(events: DataFrame) -> DataFrame:
    """Company, line and vehicle fall back to -1, direction to 'ND'; the schedule code stays NULL."""
    return events.withColumns({
        "id_empresa": or_missing("id_empresa"),
        "cod_linha": or_missing("cod_linha"),
        "cod_veiculo": or_missing("cod_veiculo"),
        "viagem_sentido": direction_or_nd(),
    })


def with_window(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Add the five-minute window; messages without an event time belong to no window and leave here."""
    return events.where(F.col("event_ts").isNotNull()).withColumn("janela_5min", window_start(F.col("event_ts"), zone))
