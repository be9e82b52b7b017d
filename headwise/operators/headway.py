"""Stop rows -> headway between consecutive arrivals of a line and direction -> delay against a reference.

Row-level ``lag`` would sort every stop row of a line, direction and day in one task. Only positive gaps matter, and a
positive gap can only appear at the first row of a new second, so the rows are first collapsed to distinct *arrival
seconds* by a hash aggregate that combines before the shuffle. A group then holds at most 86,400 rows however many stop
rows a busy (or fallback) line has, and the result is the same.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwise.functions.clock import window_start
from headwise.functions.rules import direction_or_nd, or_missing
from headwise.schemas import DIRECTION_WINDOW, MAX_HEADWAY_MIN, WINDOW_SECONDS

DIRECTION_DAY = ["event_dt", "cod_linha", "viagem_sentido"]


def arrival_seconds(stops: DataFrame) -> DataFrame:
    """Distinct arrival seconds per day, line and direction, with the number of stop rows at each."""
    return (
        # the day test is implied, but said here it is the same for every reader of this frame, which lets Spark reuse
        # the shuffles instead of repeating them with and without an inferred filter
        stops.where(F.col("event_ts").isNotNull() & F.col("event_dt").isNotNull())
        .select("event_dt", or_missing("cod_linha").alias("cod_linha"),
                direction_or_nd().alias("viagem_sentido"), "event_ts")
        .groupBy(*DIRECTION_DAY, "event_ts")
        .agg(F.count(F.lit(1)).alias("rows_at_second"))
    )


def headway_gaps(stops: DataFrame) -> DataFrame:
    """Gap in minutes from the previous arrival second; NULL for the first one of a day.

    The other ``rows_at_second - 1`` rows of a second have gap zero to their predecessor by construction.
    """
    ordered = Window.partitionBy(*DIRECTION_DAY).orderBy("event_ts")
    return (
        arrival_seconds(stops)
        .withColumn("prev_event_ts", F.lag("event_ts").over(ordered))
        .withColumn("headway_diff_min", (F.col("event_ts") - F.col("prev_event_ts")) / F.lit(60.0))
    )


def headway_gap_rows(stops: DataFrame) -> DataFrame:
    """The gap of every stop row to the previous stop row of its day, line and direction, by time, message and point; NULL for
    the first one of a day.

    Two phases. The rows are put in order within slices of five minutes, so that a busy line is spread over many tasks, and the
    rows of a slice are shuffled once. What the first row of a slice lacks, the last second before the slice, is carried over
    from a table of one row per slice, which combines before its own shuffle (at most 288 rows a day, line and direction) and
    meets the rows on the partitioning they already have. No row is joined to other rows.
    """
    rows = stops.where(F.col("event_ts").isNotNull() & F.col("event_dt").isNotNull()).select(
        "event_id", "gps_idx", "id_ponto", "event_dt", or_missing("cod_linha").alias("cod_linha"),
        direction_or_nd().alias("viagem_sentido"), "event_ts",
        F.floor(F.col("event_ts") / WINDOW_SECONDS).alias("slice"))
    key = [*DIRECTION_DAY, "slice"]
    carried = rows.groupBy(*key).agg(F.max("event_ts").alias("last_ts")).withColumn(
        "carry", F.lag("last_ts").over(Window.partitionBy(*DIRECTION_DAY).orderBy("slice"))).select(*key, "carry")
    within = Window.partitionBy(*key).orderBy("event_ts", "event_id", "gps_idx")
    before = F.coalesce("prev_ts", "carry")
    return rows.withColumn("prev_ts", F.lag("event_ts").over(within)).join(carried, key).select(
        "event_id", "gps_idx", "id_ponto", *DIRECTION_DAY, "event_ts",
        ((F.col("event_ts") - before) / F.lit(60.0)).alias("headway_diff_min"))


def headway_observed(stops: DataFrame, zone: str = "UTC") -> DataFrame:
    """Mean valid gap (0 < gap <= 180 minutes) and number of gaps per five-minute window.

    The grouping starts with the partitioning keys of the gap window, so it needs no further shuffle.
    """
    gap = F.col("headway_diff_min")
    return (
        headway_gaps(stops)
        .where((gap > 0.0) & (gap <= MAX_HEADWAY_MIN))
        .withColumn("janela_5min", window_start(F.col("event_ts"), zone))
        .groupBy(*DIRECTION_WINDOW)
        .agg(F.avg(gap).alias("headway_observado_min"), F.count(F.lit(1)).alias("n_eventos_ponto"))
        .withColumn("faixa_horaria", F.hour("janela_5min"))
    )


def headway_reference(
    observed: DataFrame, fit_until: str | dt.date | None = None, accuracy: int = 10000
) -> DataFrame:
    """Typical headway per line, direction and hour: the approximate median, a mergeable sketch of bounded size.

    By default all days take part, so the reference of a day also knows later days. ``fit_until`` keeps it to days up to
    and including that date.
    """
    fitted = observed
    if fit_until is not None:
        last = fit_until if isinstance(fit_until, dt.date) else dt.date.fromisoformat(fit_until)
        fitted = observed.where(F.col("event_dt") <= F.lit(last))
    return fitted.groupBy("cod_linha", "viagem_sentido", "faixa_horaria").agg(
        F.percentile_approx("headway_observado_min", 0.5, accuracy).alias("headway_referencia_min")
    )


def headway_delay(
    stops: DataFrame, zone: str = "UTC", fit_until: str | dt.date | None = None
) -> DataFrame:
    """Observed and reference headway with the approximate delay, one row per day, line, direction and window.

    The delay is taken here, before any outer join, because ``greatest`` skips NULLs and would turn a missing headway
    into a delay of zero. No join hint: adaptive execution broadcasts the reference only when its measured size is
    small, and otherwise joins by shuffle.
    """
    observed = headway_observed(stops, zone)
    reference = headway_reference(observed, fit_until)
    late = F.col("headway_observado_min") - F.col("headway_referencia_min")
    # fitted on all days, the reference holds every observed group: an inner join loses nothing, and as both of its sides
    # then carry the same filters the arrival shuffles are done once and reused
    how = "inner" if fit_until is None else "left"
    return (
        observed.join(reference, ["cod_linha", "viagem_sentido", "faixa_horaria"], how)
        .withColumn("atraso_aproximado_min", F.when(late.isNotNull(), F.greatest(F.lit(0.0), late)))
        .select(*DIRECTION_WINDOW, "headway_observado_min", "headway_referencia_min", "atraso_aproximado_min",
                "n_eventos_ponto")
    )
