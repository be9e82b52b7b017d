"""Next-window target, features, chronological split and median baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.operators.stats import error_metrics, exact_median
from headwise.schemas import PREDICTION_COLUMNS

SERIES = ["cod_linha", "cod_veiculo"]
CHRONOLOGY = ["janela_5min", "event_dt", "cod_linha", "cod_veiculo"]
DELAY = "atraso_aproximado_min"
# fixed values: columns that get a lag of one window
LAGGED = [
    "velocidade_media", "gps_invalid_pct", "qtd_eventos_gps", "qtd_eventos_stop", "headway_referencia_min",
    "headway_observado_min", "atraso_aproximado_min",
]
TRAIN_UNTIL, VALIDATION_UNTIL = 0.70, 0.85


def series_order() -> Window:
    """A line and vehicle in time. Gold has one row per window, so a partition is as long as the calendar, not the feed."""
    return Window.partitionBy(*SERIES).orderBy("janela_5min", "event_dt")


def target_next_window(gold: DataFrame, drop_null_first: bool = True) -> DataFrame:
    """Add ``y_true``, the delay of the next window of the same line and vehicle, and the hour of day.

    With ``drop_null_first`` the next window is the next *labelled* one; otherwise it is the next row, and rows whose
    next row has no label are dropped afterwards.
    """
    keys = ["janela_5min", "cod_linha", "cod_veiculo"]
    known = gold.dropna(subset=[DELAY, *keys] if drop_null_first else keys)
    return (
        known.withColumn("faixa_horaria", F.hour("janela_5min"))
        .withColumn("y_true", F.lead(DELAY).over(series_order()))
        .where(F.col("y_true").isNotNull())
    )


def temporal_features(frame: DataFrame) -> DataFrame:
    """Hour and minute of the window, weekday of the day (Monday is 0), weekend flag."""
    return frame.withColumns({
        "hour": F.hour("janela_5min"),
        "minute": F.minute("janela_5min"),
        "day_of_week": F.weekday("event_dt"),
        "is_weekend": F.weekday("event_dt") >= 5,
    })


def lag_features(frame: DataFrame, columns: list[str] | None = None, steps: int = 1) -> DataFrame:
    """Values of earlier windows of the same line and vehicle; one window sort serves all columns."""
    order = series_order()
    return frame.withColumns({f"lag_{steps}_{c}": F.lag(c, steps).over(order)
                              for c in (LAGGED if columns is None else columns)})


def rolling_features(frame: DataFrame, columns: list[str], windows: int = 3) -> DataFrame:
    """Mean over the previous windows, by line and vehicle and by line alone.

    A line has many vehicles per window, so its series is first reduced to one mean per window and joined back; the
    rolling frame then runs over windows and not over all rows of a busy line.
    """
    recent = series_order().rowsBetween(-windows, -1)
    own = frame.withColumns({f"roll_{windows}_vehicle_{c}": F.avg(c).over(recent) for c in columns})
    line_key = ["cod_linha", "event_dt", "janela_5min"]
    line_order = Window.partitionBy("cod_linha").orderBy("janela_5min", "event_dt").rowsBetween(-windows, -1)
    by_line = (
        frame.groupBy(*line_key)
        .agg(*[F.avg(c).alias(c) for c in columns])
        .select(*line_key, *[F.avg(c).over(line_order).alias(f"roll_{windows}_line_{c}") for c in columns])
    )
    return own.join(by_line, line_key, "left")


def split_bounds(
    frame: DataFrame, train_until: float = TRAIN_UNTIL, validation_until: float = VALIDATION_UNTIL
) -> list[tuple | None]:
    """First row of the validation and of the test part, as (window, day, line, vehicle), the window as text.

    Found by counting instead of sorting: first the window that holds the position, then the line inside that window, then
    the vehicle. Each step is a combining count followed by a running sum over counts: as many rows as there are windows,
    then lines, then vehicles. Two rows reach the driver.
    """
    per_window = frame.groupBy("janela_5min", "event_dt").agg(F.count(F.lit(1)).alias("c"))
    # one row per five minutes of the calendar: about 105,000 a year, whatever the size of the feed
    running = Window.orderBy("janela_5min", "event_dt").rowsBetween(Window.unboundedPreceding, 0)
    placed = per_window.withColumns({"upto": F.sum("c").over(running), "n": F.sum("c").over(Window.partitionBy())})
    positions = F.inline(F.array(*[
        F.struct(F.lit(i).alias("cut"), F.floor(F.col("n") * F.lit(f)).alias("position"))
        for i, f in enumerate((train_until, validation_until))
    ]))
    found = ["cut", "janela_5min", "event_dt"]

    def narrowed(counts: DataFrame, columns: list[str]) -> DataFrame:
        holds = (F.col("upto") - F.col("c") <= F.col("position")) & (F.col("position") < F.col("upto"))
        return counts.where(holds).select(*columns, (F.col("position") - F.col("upto") + F.col("c")).alias("position"))

    cuts = narrowed(placed.select("janela_5min", "event_dt", "c", "upto", positions), found)
    for column in ["cod_linha", "cod_veiculo"]:
        step = Window.partitionBy("cut").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
        counts = (
            # the cut table has two rows, whatever the feed: broadcasting it is always safe
            frame.join(F.broadcast(cuts), found[1:])
            .groupBy(*found, "position", column)
            .agg(F.count(F.lit(1)).alias("c"))
            .withColumn("upto", F.sum("c").over(step))
        )
        found = [*found, column]
        cuts = narrowed(counts, found)
    # the window travels as text, so that no client time zone can move it
    window, *rest = CHRONOLOGY
    rows = {cut: tuple(bound) for cut, *bound in cuts.select("cut", F.col(window).cast("string"), *rest).collect()}
    return [rows.get(0), rows.get(1)]


def before(bound: tuple) -> Column:
    """Rows that precede a bound in (window, day, line, vehicle) order.

    The leading comparison on the window alone is implied; it is spelled out because it can be pushed into the scan.
    """
    window, day, line, vehicle = bound
    instant = F.lit(window)  # compared as the type of the column
    rest = [("event_dt", F.lit(day)), ("cod_linha", F.lit(line)), ("cod_veiculo", F.lit(vehicle))]
    smaller = F.lit(False)
    for column, value in reversed(rest):
        smaller = (F.col(column) < value) | ((F.col(column) == value) & smaller)
    return (F.col("janela_5min") <= instant) & ((F.col("janela_5min") < instant) | smaller)


def temporal_split(
    frame: DataFrame, train_until: float = TRAIN_UNTIL, validation_until: float = VALIDATION_UNTIL
) -> DataFrame:
    """Label rows 'train', 'val' or 'test' by position in time: first floor(0.70 n), up to floor(0.85 n), the rest.

    No global sort and no row numbers: the two boundary rows are located by counting, and every row is then compared
    with them where it is. Exact as long as window, day, line and vehicle identify a row, which they do in Gold. Pass a
    stored frame: locating the bounds scans it.
    """
    first_val, first_test = split_bounds(frame, train_until, validation_until)
    if first_val is None or first_test is None:  # nothing to split
        return frame.withColumn("split", F.lit("test"))
    return frame.withColumn(
        "split", F.when(before(first_val), "train").when(before(first_test), "val").otherwise("test")
    )


def split_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("row_count_total"),
        *[F.count_if(F.col("split") == s).alias(f"row_count_{s}") for s in ("train", "val", "test")],
    )


def train_rows(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("split") == "train")


def test_rows(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("split") == "test")


# levels of the median baseline, most specific first; unused keys hold a constant
BY_LINE_HOUR, BY_LINE, OVERALL = 0, 1, 2


def fit_baseline(train: DataFrame) -> DataFrame:
    """Medians of the target by line and hour, by line, and overall, as one small table.

    All three levels go through one median computation: each row takes part once per level.
    """
    def level(number: int, line: Column, hour: Column) -> Column:
        return F.struct(F.lit(number).alias("level"), line.alias("cod_linha"), hour.alias("faixa_horaria"))

    none = F.lit(-1)
    rows = train.select("y_true", F.inline(F.array(
        level(BY_LINE_HOUR, F.col("cod_linha"), F.col("faixa_horaria")),
        level(BY_LINE, F.col("cod_linha"), none),
        level(OVERALL, none, none),
    )))
    return exact_median(rows, "y_true", ["level", "cod_linha", "faixa_horaria"], "median")


def overall_median(fitted: DataFrame) -> Column:
    """The overall training median as a scalar subquery."""
    return fitted.where(F.col("level") == OVERALL).select("median").scalar()


def baseline_predict(rows: DataFrame, fitted: DataFrame, levels: int = 3) -> DataFrame:
    """Look up the training median: line and hour, else (three levels) line, else overall.

    ``levels``: 3 is the official baseline, 2 skips the line level, 1 is the constant predictor. ``fitted`` should be
    stored; its measured size then decides between broadcast and shuffle.
    """
    out, answers = rows, []
    if levels >= 2:
        by_hour = fitted.where(F.col("level") == BY_LINE_HOUR).select(
            "cod_linha", "faixa_horaria", F.col("median").alias("line_hour_median"))
        out = out.join(by_hour, ["cod_linha", "faixa_horaria"], "left")
        answers.append(F.col("line_hour_median"))
    if levels >= 3:
        by_line = fitted.where(F.col("level") == BY_LINE).select("cod_linha", F.col("median").alias("line_median"))
        out = out.join(by_line, "cod_linha", "left")
        answers.append(F.col("line_median"))
    out = out.withColumn("overall_median", overall_median(fitted))
    return out.withColumn("y_pred", F.coalesce(*answers, "overall_median")).select(*PREDICTION_COLUMNS)


def baseline_contemporaneous(gold: DataFrame) -> DataFrame:
    """First-round baseline: median delay by line and hour over all rows, beside the delay itself. Leaky by design."""
    known = gold.where(F.col(DELAY).isNotNull()).withColumn("faixa_horaria", F.hour("janela_5min"))
    medians = exact_median(known, DELAY, ["cod_linha", "faixa_horaria"], "y_pred")
    return (
        known.withColumn("y_true", F.col(DELAY))
        .join(medians, ["cod_linha", "faixa_horaria"], "left")
        .select(*PREDICTION_COLUMNS)
    )


def metrics_table(labelled: DataFrame, fitted: DataFrame, predictions: DataFrame, model_name: str) -> DataFrame:
    """One metrics row of a run: strategy, split sizes, errors and the overall training median."""
    scored = error_metrics(predictions.withColumn("model_name", F.lit(model_name)), ["model_name"])
    sizes = ["row_count_total", "row_count_train", "row_count_val", "row_count_test"]
    return (
        scored.withColumn("size", split_sizes(labelled).select(F.struct(*sizes)).scalar())
        .withColumn("global_baseline", overall_median(fitted))
        .select(
            "model_name",
            F.lit("temporal_70_15_15").alias("split_strategy"),
            F.lit("next_window_same_line_vehicle").alias("prediction_horizon"),
            *[F.col("size")[c].alias(c) for c in sizes],
            "mae", "rmse", "wape", "medae", "mape_secondary", "global_baseline",
        )
    )


def model_comparison(model: DataFrame, baseline: DataFrame, model_name: str, baseline_name: str) -> DataFrame:
    """Errors of a model and of its baseline as two rows."""
    both = model.select("y_true", "y_pred", F.lit(model_name).alias("model_name")).unionByName(
        baseline.select("y_true", "y_pred", F.lit(baseline_name).alias("model_name"))
    )
    return error_metrics(both, ["model_name"])


def prediction_audit(predictions: DataFrame) -> DataFrame:
    """Valid and missing values per model; metrics over the valid rows only."""
    y, p = F.col("y_true"), F.col("y_pred")
    counts = predictions.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(y.isNotNull() & p.isNotNull()).alias("rows_valid"),
        F.count_if(y.isNull()).alias("null_y_true"),
        F.count_if(p.isNull()).alias("null_y_pred"),
    ).withColumn(
        "status", F.when(F.col("rows_valid") == F.col("rows_total"), "valid").otherwise("invalid_predictions")
    )
    metrics = error_metrics(predictions, ["model_name"]).select("model_name", "mae", "rmse", "medae", "wape")
    return counts.join(metrics, "model_name", "left")


def target_zero_mass(frame: DataFrame, column: str = "y_true") -> DataFrame:
    """How much of the target is exactly zero, and how much is within a tenth of a minute."""
    known = frame.where(F.col(column).isNotNull())
    return known.agg(
        F.count(F.lit(1)).alias("n_registros"),
        F.avg((F.col(column) == 0.0).cast("double")).alias("share_zero"),
        F.avg((F.abs(column) <= 0.1).cast("double")).alias("share_le_0_1"),
    )


def _prediction_means(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.avg("y_pred").alias("avg_pred_atraso_aproximado_min"),
        F.avg("y_true").alias("avg_real_atraso_aproximado_min"),
        F.count(F.lit(1)).alias("n_registros"),
    )


def line_hour_metrics(predictions: DataFrame) -> DataFrame:
    """Means by line and hour of day."""
    return _prediction_means(predictions.withColumn("faixa_horaria", F.hour("janela_5min")),
                             ["cod_linha", "faixa_horaria"])


def line_datehour_metrics(predictions: DataFrame) -> DataFrame:
    """Means by line and calendar hour, the variant that one published model used."""
    window = F.col("janela_5min")
    hour_start = F.timestamp_add("MINUTE", -F.minute(window), window)
    return _prediction_means(predictions.withColumn("data_hora", hour_start), ["cod_linha", "data_hora"])


def vehicle_day_metrics(predictions: DataFrame) -> DataFrame:
    return _prediction_means(predictions, ["event_dt", "cod_veiculo"])


def actual_delay_means(gold: DataFrame) -> DataFrame:
    """First-round summaries of the actual delay: mean by line and hour and by vehicle and day, median by line."""
    known = gold.where(F.col(DELAY).isNotNull()).withColumn("faixa_horaria", F.hour("janela_5min"))
    columns = ["summary", "cod_linha", "faixa_horaria", "cod_veiculo", "event_dt", "value"]

    def tidy(frame: DataFrame, name: str, *keys: str) -> DataFrame:
        types = dict(known.dtypes)
        return frame.select(
            F.lit(name).alias("summary"),
            *[F.col(c) if c in keys else F.lit(None).cast(types[c]).alias(c) for c in columns[1:-1]],
            "value",
        )

    line_hour = known.groupBy("cod_linha", "faixa_horaria").agg(F.avg(DELAY).alias("value"))
    vehicle_day = known.groupBy("event_dt", "cod_veiculo").agg(F.avg(DELAY).alias("value"))
    line = exact_median(known, DELAY, ["cod_linha"], "value")
    return (
        tidy(line_hour, "mean_line_hour", "cod_linha", "faixa_horaria")
        .unionByName(tidy(vehicle_day, "mean_vehicle_day", "event_dt", "cod_veiculo"))
        .unionByName(tidy(line, "median_line", "cod_linha"))
    )
