"""Summaries, rankings, comparisons and event tables over prediction and metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.ordered import number_rows, over_blocks, running_sums
from panelcast.operators.quantiles import group_quantiles
from panelcast.sources.files import union_frames
from panelcast.sources.shared import written

# Keys of the summary and comparison tables, direction metrics and the models of the short report.
SUMMARY_KEYS = ("evaluation", "experiment_key", "price_column", "prediction_horizon", "window_size", "model")
DIRECTION = ("da", "up_precision", "up_recall", "up_f1", "down_precision", "down_recall", "down_f1")
COMPARISON_KEYS = (
    "experiment_key", "evaluation", "symbol", "date", "feature_date", "target_date", "current_close",
    "actual_close", "split_start_date", "prediction_horizon", "window_size", "price_column",
)
PRIMARY_MODELS = ("arima", "garch_return", "lstm", "transformer", "arima_residual_lstm")


def usable_metrics(metrics: DataFrame) -> DataFrame:
    """Rows whose rmse and mae are finite."""
    good = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))) for c in ("rmse", "mae")]
    return metrics.where(good[0] & good[1])


def summary(metrics: DataFrame, keys: Sequence[str] = SUMMARY_KEYS) -> DataFrame:
    """Counts, rounded means and medians, best and worst symbol; one shuffle."""
    keys = [k for k in keys if k in metrics.columns]
    by_error = F.struct("rmse", "symbol")
    made = [F.count("*").alias("count")]
    for m in ("rmse", "mae", "smape"):
        made += [F.round(F.avg(m), 6).alias(f"mean_{m}"), F.round(F.median(m), 6).alias(f"median_{m}")]
    made += [F.round(F.avg(m), 6).alias(f"mean_{m}") for m in DIRECTION]
    made += [F.min_by("symbol", by_error).alias("best_symbol"), F.max_by("symbol", by_error).alias("worst_symbol")]
    return usable_metrics(metrics).groupBy(*keys).agg(*made)


def ranked(table: DataFrame) -> DataFrame:
    """Dense rank on the rounded mean rmse inside each experiment and evaluation."""
    order = Window.partitionBy("experiment_key", "evaluation").orderBy("mean_rmse")
    return table.withColumn("rank", F.dense_rank().over(order))


def best_models(table: DataFrame) -> DataFrame:
    order = Window.partitionBy("experiment_key", "evaluation").orderBy("mean_rmse", "median_rmse", "model")
    return table.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def winner_agreement(best: DataFrame) -> DataFrame:
    """Winner of each evaluation per experiment and whether they agree; both must exist."""
    wide = best.groupBy("experiment_key").pivot("evaluation", ["holdout", "walk_forward"]).agg(F.first("model"))
    both = wide.dropna(subset=["holdout", "walk_forward"])
    return both.withColumn("consistent", F.col("holdout") == F.col("walk_forward"))


def model_delta(metrics: DataFrame, model: str, baseline: str) -> DataFrame:
    """Mean rmse and smape of ``model`` less ``baseline`` over matching symbols, in one aggregation."""
    keys = ("experiment_key", "symbol", "evaluation")
    side = {n: F.when(F.col("model") == m, F.lit(1)) for n, m in (("m", model), ("b", baseline))}
    paired = metrics.groupBy(*keys).agg(
        *[F.max(F.when(s.isNotNull(), F.col(c))).alias(f"{c}_{n}") for n, s in side.items() for c in ("rmse", "smape")],
        *[F.count(s).alias(f"has_{n}") for n, s in side.items()],
    )
    both = paired.where("has_m > 0 and has_b > 0")
    return both.agg(
        F.count("*").alias("pairs"),
        F.avg(F.col("rmse_m") - F.col("rmse_b")).alias("rmse_delta"),
        F.avg(F.col("smape_m") - F.col("smape_b")).alias("smape_delta"),
    )


def _tie(order: Column) -> list[Column]:
    return [order, F.col("experiment_key"), F.col("evaluation"), F.col("model"), F.col("symbol")]


def worst_rows(metrics: DataFrame, models: Sequence[str], rows: int = 3) -> DataFrame:
    return metrics.where(F.col("model").isin(*models)).orderBy(*_tie(F.desc("rmse"))).limit(rows)


def top_and_bottom(metrics: DataFrame, rows: int = 5) -> DataFrame:
    """Best and worst rows by rmse; holdout rows where there are any, else all rows."""
    has_holdout = metrics.where("evaluation = 'holdout'").limit(1).count() > 0
    pool = metrics.where("evaluation = 'holdout'") if has_holdout else metrics
    top = pool.orderBy(*_tie(F.asc("rmse"))).limit(rows).withColumn("side", F.lit("top"))
    bottom = pool.orderBy(*[F.desc(c) for c in ("rmse", "experiment_key", "evaluation", "model", "symbol")]).limit(rows)
    return top.unionByName(bottom.withColumn("side", F.lit("bottom")))


def error_by_step(predictions: DataFrame) -> DataFrame:
    walked = predictions.where("evaluation = 'walk_forward'")
    return walked.groupBy("step").agg(F.avg("abs_error").alias("abs_error"))


def comparison(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per prediction target with the forecasts of every model side by side, in one shuffle."""
    made = []
    for m in models:
        name, mine = m.replace("-", "_"), F.col("model") == m
        made += [
            F.max(F.when(mine, F.col("predicted"))).alias(f"pred_{name}"),
            F.max(F.when(mine, F.col("abs_error"))).alias(f"abs_error_{name}"),
            F.max(F.when(mine, F.col("direction_correct"))).alias(f"dir_correct_{name}"),
        ]
    return predictions.groupBy(*COMPARISON_KEYS).agg(*made)


EVENT_KEYS = ("experiment_key", "evaluation", "symbol")


def extreme_moves(compared: DataFrame, level: float = 0.95) -> DataFrame:
    """Flag rows whose absolute return reaches the quantile of their experiment, evaluation and symbol."""
    moved = compared.withColumn(
        "abs_return_1d", F.abs(F.try_divide(F.col("actual_close") - F.col("current_close"), F.col("current_close")))
    )
    limits = written(group_quantiles(moved, EVENT_KEYS, ["abs_return_1d"], {"q": level}), "limits")
    return moved.join(limits, list(EVENT_KEYS)).withColumn(
        "is_extreme_volatility", F.coalesce(F.col("abs_return_1d") >= F.col("abs_return_1d__q"), F.lit(False))
    ).drop("abs_return_1d__q")


def event_ids(flagged: DataFrame, rows: int | None = None) -> DataFrame:
    """Consecutive extreme rows of one experiment, evaluation and symbol share an event id; other rows have none."""
    by = list(EVENT_KEYS)
    numbered = written(number_rows(flagged, by, "target_date", out="_seq"), "flagged")

    def compute(frame: DataFrame, w) -> DataFrame:
        before = F.coalesce(F.lag("is_extreme_volatility", 1).over(w), F.lit(False))
        return frame.withColumn("_start", (F.col("is_extreme_volatility") & ~before).cast("int"))

    marked = over_blocks(numbered, by, compute, back=1, seq="_seq", rows=rows)
    counted = running_sums(marked, by, {"_event": F.col("_start").cast("double")}, position="_seq", rows=rows)
    name = F.format_string("%s-%s-EV%03d", F.col("symbol"), F.col("evaluation"), F.col("_event").cast("int"))
    return counted.withColumn("event_id", F.when(F.col("is_extreme_volatility"), name)).drop("_start", "_event", "_seq")


def leaderboard(tables: Sequence[DataFrame]) -> DataFrame:
    return union_frames(tables).orderBy("experiment_key", "evaluation", "rmse", "mae")


def error_grid(metrics: DataFrame, experiments: Sequence[str] = ()) -> DataFrame:
    """Mean rmse per evaluation and model, one column per experiment; without a list, for all experiments there are."""
    names = list(experiments) or sorted(r.experiment_key for r in metrics.select("experiment_key").distinct().collect())
    return metrics.groupBy("evaluation", "model").pivot("experiment_key", names).agg(F.avg("rmse"))


def direction_means(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("evaluation", "model").agg(*[F.avg(c).alias(c) for c in ("da", "up_f1", "down_f1")])


def training_curve(log: DataFrame, x: str, loss: str, phase: str = "selection") -> DataFrame:
    """Mean and sample deviation of a loss by model and epoch (here: grid candidate)."""
    kept = log.where((F.col("phase") == phase) & F.col(x).isNotNull() & F.col(loss).isNotNull())
    return kept.groupBy("model", x).agg(
        F.avg(loss).alias(f"mean_{loss}"), F.coalesce(F.stddev_samp(loss), F.lit(0.0)).alias(f"std_{loss}")
    )


def example_series(metrics: DataFrame, predictions: DataFrame, experiments: int = 4) -> DataFrame:
    """Series of the best symbol of the best holdout model, for the first few experiments."""
    held = metrics.where("evaluation = 'holdout'")
    means = held.groupBy("experiment_key", "model").agg(F.avg("rmse").alias("_mean"))
    best = means.groupBy("experiment_key").agg(F.min_by("model", F.struct("_mean", "model")).alias("model"))
    first = best.orderBy("experiment_key").limit(experiments)
    symbols = (
        held.join(first, ["experiment_key", "model"], "left_semi")
        .groupBy("experiment_key", "model")
        .agg(F.min_by("symbol", F.struct("rmse", "symbol")).alias("symbol"))
    )
    series = predictions.where("evaluation = 'holdout'").join(symbols, ["experiment_key", "model", "symbol"], "left_semi")
    return series.select("experiment_key", "model", "symbol", "target_date", "actual_close", "predicted")


def primary_subset(predictions: DataFrame, selected: Sequence[str], primary: Sequence[str] = PRIMARY_MODELS) -> DataFrame:
    return predictions.where(F.col("model").isin(*[m for m in primary if m in selected]))


def largest_symbols(panel: DataFrame, rows: int = 2) -> DataFrame:
    return panel.groupBy("symbol").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "symbol").limit(rows)


def missing_runs(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid combinations without results."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def run_audit(grid: DataFrame, status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected, finished, failed and missing combinations, and whether the run is complete."""
    state = grid.join(status.groupBy(*keys).agg(F.max_by("status", "attempt").alias("status")), list(keys), "left")
    counts = state.agg(
        F.count("*").alias("expected"),
        F.count_if(F.col("status") == "done").alias("finished"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isNull()).alias("missing"),
    )
    return counts.withColumn("complete", (F.col("failed") == 0) & (F.col("finished") >= F.col("expected")))
