"""Prediction rows and the error and direction metrics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.sources.shared import written

# Names and order of the metrics and of their keys.
METRICS = (
    "mae", "mse", "rmse", "smape", "da", "direction_count", "up_precision", "up_recall", "up_f1",
    "down_precision", "down_recall", "down_f1",
)
METRIC_KEYS = (
    "symbol", "model", "evaluation", "feature_count", "feature_set", "price_column", "prediction_horizon",
    "window_size", "experiment_key",
)
SMALLEST_SCALE = 1e-8


def experiment_key(price: Column, horizon: Column, window: Column) -> Column:
    return F.format_string("%s_h%d_w%d", price, horizon, window)


def first_test_dates(samples: DataFrame) -> DataFrame:
    """First test date per symbol; a short written table, so it is broadcast if it is small."""
    first = samples.where("split = 'test' and step = 1")
    return written(first.select("symbol", F.col("feature_date").alias("split_start_date")), "starts")


def prediction_rows(
    scored: DataFrame,
    starts: DataFrame,
    *,
    model: str,
    evaluation: str,
    feature_count: int,
    feature_set: str,
    horizon: int,
    window: int,
    price: str = "adjclose",
    target: str = "target",
) -> DataFrame:
    """The 19 prediction columns; ``scored`` brings predicted, step and the supervised columns.

    ``starts`` comes from :func:`first_test_dates`, so the forecasts are not computed a second time for it.
    """
    guess, truth, now = F.col("predicted"), F.col(target), F.col("current_close")
    moved = F.signum(truth - now)
    return scored.join(starts, "symbol").select(
        "feature_date",
        "target_date",
        "symbol",
        F.col("target_date").alias("date"),
        now.alias("current_close"),
        truth.alias("actual_close"),
        guess.alias("predicted"),
        F.abs(truth - guess).alias("abs_error"),
        F.when(guess.isNotNull() & (moved != 0), F.signum(guess - now) == moved).alias("direction_correct"),
        F.lit(model).alias("model"),
        F.lit(evaluation).alias("evaluation"),
        F.col("step").cast("int").alias("step"),
        "split_start_date",
        F.lit(feature_count).alias("feature_count"),
        F.lit(feature_set).alias("feature_set"),
        F.lit(horizon).alias("prediction_horizon"),
        F.lit(window).alias("window_size"),
        F.lit(price).alias("price_column"),
        experiment_key(F.lit(price), F.lit(horizon), F.lit(window)).alias("experiment_key"),
    )


def _share(hits: Column, of: Column) -> Column:
    return F.try_divide(F.sum(hits.cast("double")), F.sum(of.cast("double")))


def metric_columns(actual: str = "target", predicted: str = "predicted", current: str = "current_close") -> list[Column]:
    """All metrics as aggregates over one group; direction metrics skip rows that did not move.

    Errors are null as soon as one forecast of the group is missing, so a model that leaves out hard rows does
    not rank above one that answers all; rankings skip such groups.
    """
    y, g, now = F.col(actual), F.col(predicted), F.col(current)
    error = F.abs(y - g)
    moved, guessed = F.signum(y - now), F.signum(g - now)
    counts = moved != 0
    whole = F.count(g) == F.count("*")
    mse = F.when(whole, F.avg(F.pow(y - g, 2)))
    made = {
        "mae": F.when(whole, F.avg(error)),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "smape": F.when(whole, F.avg(2 * error / F.greatest(F.abs(y) + F.abs(g), F.lit(SMALLEST_SCALE)))),
        "da": F.avg(F.when(counts, F.coalesce(guessed == moved, F.lit(False)).cast("double"))),
        "direction_count": F.count_if(counts),
    }
    for name, side in (("up", 1.0), ("down", -1.0)):
        truth = counts & (moved == side)
        guess = counts & F.coalesce(guessed == side, F.lit(False))
        precision, recall = _share(truth & guess, guess), _share(truth & guess, truth)
        made[f"{name}_precision"] = precision
        made[f"{name}_recall"] = recall
        made[f"{name}_f1"] = F.try_divide(2 * precision * recall, precision + recall)
    return [made[m].alias(m) for m in METRICS]


def metrics(predictions: DataFrame, keys: tuple[str, ...] = METRIC_KEYS) -> DataFrame:
    return predictions.groupBy(*keys).agg(*metric_columns("actual_close"))


def forecast_counts(predictions: DataFrame, keys: tuple[str, ...] = METRIC_KEYS) -> DataFrame:
    """Rows and rows with a forecast per group; they differ where a feature or a fitted model was missing."""
    return predictions.groupBy(*keys).agg(F.count("*").alias("row_count"), F.count("predicted").alias("forecast_count"))


def sorted_metrics(frame: DataFrame) -> DataFrame:
    """For writing: ordered by evaluation, rmse, mae."""
    return frame.orderBy("evaluation", "rmse", "mae")


def sorted_predictions(frame: DataFrame) -> DataFrame:
    return frame.orderBy("symbol", "evaluation", "target_date", "feature_date")
