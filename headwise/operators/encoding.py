"""Target means as codes of categories with many values (lines, vehicles), without telling a row its own answer.

The code of a training row is the mean target of the other folds' training rows of its category; rows to validate or predict get
the mean of all training rows of theirs. Means are drawn towards the global one by ``prior`` rows, and a category that was not
seen gets the global mean. Everything is a combining aggregate over category and fold and one join per category column, on a
table of one row per category and fold; a vehicle with a third of all rows is one row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.operators.forecast import train_rows

FOLDS, PRIOR = 5, 1.0
ROW_KEY = ["event_dt", "janela_5min", "cod_linha", "cod_veiculo"]


def fold_of(columns: list[str], folds: int = FOLDS) -> Column:
    """A fold by the hash of some columns, the same wherever the row is computed."""
    return F.pmod(F.xxhash64(*columns), F.lit(folds)).cast("int")


def category_means(train: DataFrame, column: str, prior: float = PRIOR) -> DataFrame:
    """``train`` has ``column``, _fold, y_true. category, fold, mean: the mean without that fold; with fold -1 over all folds."""
    by_fold = train.where(F.col("y_true").isNotNull()).groupBy(F.col(column).alias("category"), F.col("_fold").alias("fold")).agg(
        F.sum("y_true").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = by_fold.groupBy("category").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = by_fold.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("overall"))  # one row
    own = by_fold.select(F.col("category").alias("own"), "fold", F.col("s").alias("own_s"), F.col("n").alias("own_n"))
    without = whole.join(own, F.col("category").eqNullSafe(F.col("own"))).select(
        "category", "fold", (F.col("s") - F.col("own_s")).alias("s"), (F.col("n") - F.col("own_n")).alias("n"))
    both = without.unionByName(whole.select("category", F.lit(-1).alias("fold"), "s", "n"))
    return both.join(F.broadcast(total), F.lit(True)).select(
        "category", "fold", ((F.col("s") + prior * F.col("overall")) / (F.col("n") + prior)).alias("mean"), "overall")


def with_target_means(labelled: DataFrame, columns: list[str], fold: Column | None = None, prior: float = PRIOR) -> DataFrame:
    """``labelled`` with ``<column>_mean`` for every column. ``fold``: number of the fold of a row, by default a hash of its key.
    Without training rows the codes are zero."""
    out = labelled.withColumn("_fold", fold_of(ROW_KEY) if fold is None else fold.cast("int"))
    train = train_rows(out).select(*dict.fromkeys([*columns, "_fold", "y_true"]))
    asked = F.when(F.col("split") == "train", F.col("_fold")).otherwise(F.lit(-1))
    overall = train.agg(F.coalesce(F.avg("y_true"), F.lit(0.0)).alias("_overall"))  # one row
    out = out.withColumn("_asked", asked).join(F.broadcast(overall), F.lit(True))
    for column in columns:
        means = category_means(train, column, prior).select(
            F.col("category").alias("_category"), F.col("fold").alias("_of"), F.col("mean").alias("_mean"))
        out = out.join(means, F.col(column).eqNullSafe(F.col("_category")) & (F.col("_asked") == F.col("_of")), "left").withColumn(
            f"{column}_mean", F.coalesce("_mean", "_overall")).drop("_category", "_of", "_mean")
    return out.drop("_fold", "_asked", "_overall")

