"""Silver -> Gold: one row per day, line, vehicle and five-minute window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.functions.rules import gps_is_invalid, or_missing, outside, with_window
from headwise.operators.headway import headway_delay
from headwise.schemas import (
    CONTRACT_COLUMNS, DIRECTION_WINDOW, GOLD_COLUMNS, MISSING_DIRECTION, MISSING_KEY, SILVER_COLUMNS, SILVER_TABLES, VEHICLE_WINDOW,
)
from headwise.sources.staging import stage

ContractFn = Callable[[dict[str, DataFrame]], DataFrame]

# columns all four Silver tables share, plus the derived flag
UNION_COLUMNS = [c for c in SILVER_COLUMNS["gps_events"] if all(c in cols for cols in SILVER_COLUMNS.values())]
# fixed values: columns each Silver table must bring to the contract step
REQUIRED_SILVER = {
    "gps_events": [
        "event_id", "gps_idx", "event_ts", "event_dt", "id_empresa", "cod_linha", "cod_veiculo", "gps_sinal",
        "latitude", "longitude",
    ],
    "stop_events": ["event_id", "gps_idx", "event_ts", "event_dt", "id_empresa", "cod_linha", "cod_veiculo"],
    "fare_events": ["event_id", "gps_idx", "event_ts", "event_dt", "id_empresa", "cod_linha", "cod_veiculo"],
    "operational_events": ["event_id", "gps_idx", "event_ts", "event_dt", "id_empresa", "cod_linha", "cod_veiculo"],
}


def earliest(column: str) -> Column:
    """First known value by event time, the smallest of those at the same second: NULLs are skipped. For rows that
    ``_by_value`` has already reduced."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct("first_ts", column)))


def _by_value(rows: DataFrame, values: list[str], *measures: Column) -> DataFrame:
    """First step of a window aggregate that also wants the earliest value of some columns: one row per window and value.

    Only numbers of fixed width are kept per group, so this step, which sees every raw row, hashes and never sorts; the
    second step orders the few rows it leaves."""
    return rows.groupBy(*VEHICLE_WINDOW, *values).agg(F.min("event_ts").alias("first_ts"), *measures)


def _mean_parts(columns: list[str]) -> list[Column]:
    return [part for c in columns for part in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]


def _mean(column: str) -> Column:
    return F.try_divide(F.sum(f"sum_{column}"), F.sum(f"n_{column}"))


def _vehicle_windows(events: DataFrame, zone: str) -> DataFrame:
    return with_window(events, zone).withColumns({
        "cod_linha": or_missing("cod_linha"), "cod_veiculo": or_missing("cod_veiculo"),
    })


def vehicle_window_context(gps_events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Position, speed and GPS quality of a vehicle in a window. Every aggregate combines before the shuffle."""
    averaged = ["latitude", "longitude", "velocidade", "bad"]
    rows = _vehicle_windows(gps_events, zone).withColumn("bad", gps_is_invalid().cast("double"))
    reduced = _by_value(
        rows, ["id_empresa", "viagem_sentido"], *_mean_parts(averaged), F.count(F.lit(1)).alias("n"),
        F.max("numero_satelites").alias("satelites"),
    )
    return reduced.groupBy(*VEHICLE_WINDOW).agg(
        F.coalesce(earliest("id_empresa"), F.lit(MISSING_KEY)).alias("id_empresa"),
        F.coalesce(earliest("viagem_sentido"), F.lit(MISSING_DIRECTION)).alias("viagem_sentido"),
        _mean("latitude").alias("latitude_media"),
        _mean("longitude").alias("longitude_media"),
        _mean("velocidade").alias("velocidade_media"),
        _mean("bad").alias("gps_invalid_pct"),
        F.sum("n").alias("qtd_eventos_gps"),
        F.max("satelites").alias("max_satelites"),
    )


def stop_vehicle_windows(stop_events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Direction and number of stop rows of a vehicle in a window (rows are points, not messages)."""
    reduced = _by_value(_vehicle_windows(stop_events, zone), ["viagem_sentido"], F.count(F.lit(1)).alias("n"))
    return reduced.groupBy(*VEHICLE_WINDOW).agg(
        F.coalesce(earliest("viagem_sentido"), F.lit(MISSING_DIRECTION)).alias("viagem_sentido"),
        F.sum("n").alias("qtd_eventos_stop"),
    )


def union_events(tables: dict[str, DataFrame]) -> DataFrame:
    """Four tables on their common columns; keeps every row.

    A stop or fare point is in ``gps_events`` too, so the union counts such points twice, as its inputs do.
    """
    for name, needed in REQUIRED_SILVER.items():
        if name not in tables:
            raise ValueError(f"missing table: {name}")
        absent = [c for c in needed if c not in tables[name].columns]
        if absent:
            raise ValueError(f"{name} lacks columns {absent}")
    aligned = [
        tables[name].select(*[c for c in UNION_COLUMNS if c in tables[name].columns]) for name in SILVER_TABLES
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
    return stacked.withColumns({
        "id_empresa": or_missing("id_empresa"),
        "cod_linha": or_missing("cod_linha"),
        "cod_veiculo": or_missing("cod_veiculo"),
        "gps_is_invalid": gps_is_invalid(),
    })


def union_events_strict(tables: dict[str, DataFrame]) -> DataFrame:
    """Union by name that refuses tables with different columns."""
    return reduce(lambda a, b: a.unionByName(b), [tables[name] for name in SILVER_TABLES])


def contract_table(tables: dict[str, DataFrame], zone: str = "UTC") -> DataFrame:
    """Minimal Gold contract: keys and window, with the three delay columns still empty."""
    return with_window(union_events(tables), zone).select(
        *VEHICLE_WINDOW, *[F.lit(None).cast("double").alias(c) for c in CONTRACT_COLUMNS[len(VEHICLE_WINDOW):]]
    )


def check_contract_schema(frame: DataFrame) -> None:
    """Schema half of the contract, decided without a job."""
    absent = [c for c in CONTRACT_COLUMNS if c not in frame.columns]
    if absent:
        raise ValueError(f"contract columns missing: {absent}")
    for column in CONTRACT_COLUMNS[len(VEHICLE_WINDOW):]:
        if not isinstance(frame.schema[column].dataType, T.DoubleType):
            raise TypeError(f"{column} must be double, is {frame.schema[column].dataType.simpleString()}")


def contract_report(frame: DataFrame) -> DataFrame:
    """Data half of the contract: all counts in one pass, one row out."""
    check_contract_schema(frame)
    off_range = F.lit(False)
    if {"latitude", "longitude"} <= set(frame.columns):
        off_range = outside("latitude", 90.0) | outside("longitude", 180.0)
    report = frame.agg(
        F.count(F.lit(1)).alias("rows_total"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}_rows") for c in ("event_dt", "cod_linha", "cod_veiculo")],
        F.count_if(off_range).alias("coord_out_of_range_rows"),
    )
    bad = sum((F.col(c) for c in report.columns[1:]), F.lit(0))
    return report.withColumn("status", F.when(bad == 0, "ok").otherwise("violated"))


def assert_contract(frame: DataFrame) -> None:
    """Raise unless the contract holds. Only the one-row report reaches the driver."""
    row = contract_report(frame).first()
    if row["status"] != "ok":
        raise ValueError(f"contract violated: {row.asDict()}")


def limited_to_contract(windows: DataFrame, contract: DataFrame) -> DataFrame:
    """Windows whose key the contract holds. The contract has a row per point, so its keys are combined before the semi join:
    what a task sorts, or holds as a broadcast table, then grows with the windows and not with the points in them."""
    return windows.join(contract.select(*VEHICLE_WINDOW).distinct(), VEHICLE_WINDOW, "left_semi")


def stop_windows_with_context(
    stop_windows: DataFrame, context: DataFrame, contract: DataFrame | None = None
) -> DataFrame:
    """Stop windows, optionally limited to the contract keys, with the vehicle context of the same window.

    Both sides are already grouped by the join keys, so the left join reuses their partitioning.
    """
    kept = stop_windows
    if contract is not None:
        kept = limited_to_contract(kept, contract)
    side = context.withColumnsRenamed({"viagem_sentido": "ctx_sentido", "id_empresa": "ctx_empresa"})
    return kept.join(side, VEHICLE_WINDOW, "left").withColumns({
        # stop direction 'ND' is already a value here and wins over the vehicle context, as in the published table
        "viagem_sentido": F.coalesce("viagem_sentido", "ctx_sentido", F.lit(MISSING_DIRECTION)),
        "id_empresa": F.coalesce("ctx_empresa", F.lit(MISSING_KEY)),
    }).drop("ctx_sentido", "ctx_empresa")


def build_gold(
    tables: dict[str, DataFrame],
    zone: str = "UTC",
    contract: DataFrame | None = None,
    fit_until: str | dt.date | None = None,
) -> DataFrame:
    """Assemble the sixteen-column table.

    Only stop windows become rows. With the default contract the key restriction cannot remove anything (its keys come
    from a union that contains the stop rows), so ``contract=None`` skips that union altogether.
    """
    base = stop_windows_with_context(
        stop_vehicle_windows(tables["stop_events"], zone),
        vehicle_window_context(tables["gps_events"], zone),
        contract,
    )
    delays = headway_delay(tables["stop_events"], zone, fit_until).drop("n_eventos_ponto")
    return (
        base.join(delays, DIRECTION_WINDOW, "left")
        .withColumns({
            "gps_invalid_pct": F.coalesce("gps_invalid_pct", F.lit(0.0)),
            "qtd_eventos_gps": F.coalesce("qtd_eventos_gps", F.lit(0).cast("bigint")),
        })
        .select(*GOLD_COLUMNS)
    )


def materialize_gold(
    tables: dict[str, DataFrame],
    contract_fn: ContractFn | None = None,
    zone: str = "UTC",
    partitions: int | None = None,
    fit_until: str | dt.date | None = None,
) -> DataFrame:
    """Gold with an optional user transform. A custom transform is computed once: what the contract checks of it is stored,
    checked, and its keys limit those of the result.

    ``partitions`` fixes the output layout by day and line; by default the size of the output decides. ``fit_until`` keeps
    the reference headway to days up to that date.
    """
    contract = None
    if contract_fn is not None:
        given = contract_fn(tables)
        check_contract_schema(given)
        checked = [c for c in (*CONTRACT_COLUMNS, "latitude", "longitude") if c in given.columns]
        contract = stage(given.select(*checked), "contract")
        assert_contract(contract)
    gold = build_gold(tables, zone, contract, fit_until)
    return gold.repartition(partitions, "event_dt", "cod_linha") if partitions else gold


def align_events(tables: dict[str, DataFrame]) -> DataFrame:
    """Full outer alignment of the four tables on message and point: one row per key, columns prefixed by table.

    Written as one union and one grouping instead of three full joins: a single shuffle that combines copies beforehand,
    where joins would pair every copy of a key with every other. Copies are kept as a count per table; of copies that
    differ, the latest row represents the table. A message without points keeps its NULL index as its key.
    """
    keys, shown = ["event_id", "gps_idx"], ["event_ts", "event_dt", "cod_linha", "cod_veiculo"]
    sides = [tables[name].select(*keys, F.lit(name).alias("table_name"), F.struct(*shown).alias("row"))
             for name in SILVER_TABLES]
    stacked = reduce(lambda a, b: a.unionByName(b), sides)

    def of(name: str) -> Column:
        return F.when(F.col("table_name") == name, F.col("row"))

    grouped = stacked.groupBy(*keys).agg(
        *[F.max(of(name)).alias(name) for name in SILVER_TABLES],
        *[F.count(of(name)).alias(f"{name}_rows") for name in SILVER_TABLES],
    )
    return grouped.select(*keys, *[
        column
        for name in SILVER_TABLES
        for column in (
            *[F.col(name)[c].alias(f"{name.removesuffix('_events')}_{c}") for c in shown],
            F.col(f"{name}_rows").alias(f"{name.removesuffix('_events')}_rows"),
        )
    ])


def gold_validation(gold: DataFrame, max_null_pct: float = 10.0) -> DataFrame:
    """Rows, empty targets, their share, and whether the share is acceptable."""
    empty = F.col("atraso_aproximado_min").isNull()
    counts = gold.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(empty).alias("null_target"))
    share = F.when(F.col("row_count") > 0, F.col("null_target") / F.col("row_count") * 100.0).otherwise(0.0)
    return counts.select(
        "row_count", "null_target", (F.col("row_count") - F.col("null_target")).alias("non_null_target"),
        share.alias("null_target_pct"),
        F.when(share <= max_null_pct, "ok").otherwise("warning").alias("target_quality_status"),
    )
