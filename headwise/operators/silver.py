"""Silver event tables: routing, checks, preview and sampling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.schemas import CARD_FARE, POSITION, PREVIEW_COLUMNS, SILVER_COLUMNS, STOP_CALL
from headwise.sources.lake import swap_silver
from headwise.sources.versions import Commit, stored_days
from headwise.sources.staging import stage


def route_predicate(table: str) -> Column:
    """Rows that belong to a table. A NULL message type fits no typed table, by three-valued logic."""
    kind = F.col("tipo_mensagem")
    return {
        # every exploded point of every message type, not only positioning messages
        "gps_events": F.col("gps_idx").isNotNull(),
        "stop_events": kind == STOP_CALL,
        "fare_events": kind == CARD_FARE,
        "operational_events": ~kind.isin(POSITION, STOP_CALL, CARD_FARE),
    }[table]


def silver_table(points: DataFrame, table: str) -> DataFrame:
    return points.where(route_predicate(table)).select(*SILVER_COLUMNS[table])


def silver_tables(points: DataFrame, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """All four tables, or the named ones."""
    return {table: silver_table(points, table) for table in (SILVER_COLUMNS if names is None else names)}


def ingest(points: DataFrame, base: str, mode: str = "overwrite", days: Iterable[str | dt.date | None] = ()) -> dict[str, Commit]:
    """Write the four tables as versioned days. The points are stored once, so the feed is parsed once, and every table is cut
    from the copy. ``days``: days that are replaced even where no row of them is left."""
    stored = stage(points, "points")
    return {table: swap_silver(frame, base, table, mode, days) for table, frame in silver_tables(stored).items()}


def tag_tables(points: DataFrame) -> DataFrame:
    """Every point once per table it belongs to, with ``table_name``: all tables are measured in one scan."""
    member = [F.when(route_predicate(table), F.lit(table)) for table in SILVER_COLUMNS]
    return points.select("*", F.explode(F.array_compact(F.array(*member))).alias("table_name"))


def stack_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Same shape as ``tag_tables`` for tables that are already stored apart."""
    tagged = [frame.withColumn("table_name", F.lit(name)) for name, frame in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


# fixed values: distinct counts reported per table
VALIDATED_DISTINCT = {
    "gps_events": {"distinct_event_id": "event_id"},
    "stop_events": {"distinct_event_id": "event_id", "distinct_id_ponto": "id_ponto"},
    "fare_events": {
        "distinct_event_id": "event_id", "distinct_cod_linha": "cod_linha", "distinct_cod_veiculo": "cod_veiculo",
    },
    "operational_events": {},
}


def validate_silver(table: DataFrame, name: str, approximate: bool = False, fail_when_empty: bool = False) -> DataFrame:
    """Rows, time range and distinct counts of one table in a single aggregate.

    ``approximate`` swaps the exact distinct counts for sketches: same plan shape, no shuffle of the keys.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    report = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("event_ts").alias("min_ts"),
        F.max("event_ts").alias("max_ts"),
        *[count(F.col(source)).alias(target) for target, source in VALIDATED_DISTINCT[name].items()],
    ).select(F.lit(name).alias("table_name"), "*")
    if fail_when_empty:
        report = report.withColumn(
            "rows",
            F.when(F.col("rows") > 0, F.col("rows")).otherwise(
                F.raise_error(F.lit(f"{name} has no rows")).cast("bigint")
            ),
        )
    return report


def validate_tagged(tagged: DataFrame) -> DataFrame:
    """The validation of all tables in one scan and one shuffle of reduced rows: each distinct count becomes a grouping.

    Rows are first grouped by table, kind of value and value (kind 0 is the row itself, of which only the count and the time
    range are kept); the second step counts the values of each kind."""
    wanted = sorted({(target, source) for pairs in VALIDATED_DISTINCT.values() for target, source in pairs.items()})
    asked = {target: [t for t, pairs in VALIDATED_DISTINCT.items() if target in pairs] for target, _ in wanted}
    kinds = [F.struct(F.lit("").alias("kind"), F.lit(None).cast("string").alias("value"))] + [
        F.when(F.col("table_name").isin(asked[target]) & F.col(source).isNotNull(), F.struct(
            F.lit(target).alias("kind"), F.col(source).cast("string").alias("value"))) for target, source in wanted]
    values = tagged.select("table_name", "event_ts", F.explode(F.array_compact(F.array(*kinds))).alias("k")).groupBy(
        "table_name", "k.kind", "k.value").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_ts").alias("low"), F.max("event_ts").alias("high"))
    whole = F.col("kind") == ""
    counted = values.groupBy("table_name").agg(
        F.sum(F.when(whole, F.col("n"))).alias("rows"), F.min(F.when(whole, F.col("low"))).alias("min_ts"),
        F.max(F.when(whole, F.col("high"))).alias("max_ts"),
        *[F.count_if(F.col("kind") == target).alias(target) for target, _ in wanted])
    # which counts a table reports is decided behind the grouping, whose key the name is: only numbers are aggregated
    return counted.select(
        "table_name", "rows", "min_ts", "max_ts",
        *[F.when(F.col("table_name").isin(asked[target]), F.col(target)).alias(target) for target, _ in wanted])


def preview(points: DataFrame, rows: int) -> DataFrame:
    return points.select(*PREVIEW_COLUMNS).limit(rows)


def sample_rows(frame: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Uniform sample without replacement."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"fraction must be in (0, 1], got {fraction}")
    return frame.sample(withReplacement=False, fraction=fraction, seed=seed)


def limit_rows(frame: DataFrame, rows: int) -> DataFrame:
    if rows <= 0:
        raise ValueError(f"row limit must be positive, got {rows}")
    return frame.limit(rows)


def silver_days(table: DataFrame) -> DataFrame:
    """Days present in a table, in order."""
    return table.where(F.col("event_dt").isNotNull()).select("event_dt").distinct().orderBy("event_dt")


def stored_silver_days(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Days of a stored table, in order, from its manifest: no data file is read."""
    days = [(day,) for day in stored_days(spark, f"{base.rstrip('/')}/{name}") if day is not None]
    return spark.createDataFrame(days, "event_dt date")
