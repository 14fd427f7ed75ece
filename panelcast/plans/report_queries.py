"""Queries over prediction rows, metrics, rankings, comparisons and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.columns import rounded
from panelcast.operators import autoregression as ar
from panelcast.operators import iterative, report
from panelcast.operators.evaluate import METRIC_KEYS, METRICS, forecast_counts, metrics, sorted_metrics, sorted_predictions
from panelcast.plans import sql
from panelcast.plans.catalogue import query
from panelcast.plans.experiments import COMPARED, metric_rows, predictions
from panelcast.plans.forecast_queries import CLIPPED_TWO, FORECAST, forecast_rows, metric_output, metric_output_sql
from panelcast.plans.panels import panel, samples, split_panel
from panelcast.sources import files, sinks
from panelcast.sources.shared import new_path

RND = sql.rnd
_ID = [c for c in sql.PREDICTION_COLUMNS if c not in ("predicted", "abs_error")]
_PREDICTIONS_SQL = f"SELECT {', '.join(_ID)}, {RND('predicted', 2)} AS predicted, {RND('abs_error', 2)} AS abs_error FROM predictions"


def _prediction_output(df: DataFrame) -> DataFrame:
    return df.select(*_ID, rounded("predicted", 2).alias("predicted"), rounded("abs_error", 2).alias("abs_error"))


@query("h1_prediction_rows", sql.predictions() + " " + _PREDICTIONS_SQL)
def h1_prediction_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _prediction_output(predictions(spark, folder))


def _metric_query(name: str, names: list[str]) -> None:
    @query(name, sql.metrics() + f" SELECT {sql.METRIC_KEYS}, {metric_output_sql(names)} FROM metrics")
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return metric_output(metrics(predictions(spark, folder)), list(METRIC_KEYS), names)


_metric_query("h2_error_metrics", ["mae", "mse", "rmse", "smape"])
_metric_query("h3_direction_accuracy", ["da", "direction_count"])
_metric_query("h4_direction_classes", [m for m in METRICS if m.startswith(("up", "down"))])


@query("h5_sorted_predictions", sql.predictions() + " " + _PREDICTIONS_SQL + " ORDER BY symbol, evaluation, target_date, feature_date")
def h5_sorted_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return _prediction_output(sorted_predictions(predictions(spark, folder)))


@query("h5_sorted_metrics", sql.metrics() + f" SELECT {sql.METRIC_KEYS}, {metric_output_sql(['rmse', 'mae'])} FROM metrics ORDER BY evaluation, rmse, mae")
def h5_sorted_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metric_output(sorted_metrics(metric_rows(spark, folder)), list(METRIC_KEYS), ["rmse", "mae"])


_LARGE = ["mean_rmse", "median_rmse", "mean_mae", "median_mae"]
_SMALL = ["mean_smape", "median_smape", *[f"mean_{m}" for m in report.DIRECTION]]


@query(
    "h6_summary",
    sql.summary() + f" SELECT {sql.SUMMARY_KEYS}, count, {sql.rounded_columns(_LARGE, 3)}, {sql.rounded_columns(_SMALL, 5)} FROM summary",
)
def h6_summary(spark: SparkSession, folder: str) -> DataFrame:
    made = report.summary(metric_rows(spark, folder))
    return made.select(
        *report.SUMMARY_KEYS, "count", *[rounded(c, 3).alias(c) for c in _LARGE], *[rounded(c, 5).alias(c) for c in _SMALL]
    )


@query("h7_best_and_worst_symbols", sql.summary() + f" SELECT {sql.SUMMARY_KEYS}, best_symbol, worst_symbol FROM summary")
def h7_best_and_worst_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return report.summary(metric_rows(spark, folder)).select(*report.SUMMARY_KEYS, "best_symbol", "worst_symbol")


@query("h8_ranks", sql.summary() + " SELECT experiment_key, evaluation, model, rank::INTEGER AS rank FROM ranked")
def h8_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return report.ranked(report.summary(metric_rows(spark, folder))).select("experiment_key", "evaluation", "model", "rank")


_BEST_COLUMNS = ["mean_rmse", "mean_mae"]


@query("h9_best_models", sql.summary() + f" SELECT experiment_key, evaluation, model, best_symbol, {sql.rounded_columns(_BEST_COLUMNS, 3)} FROM best")
def h9_best_models(spark: SparkSession, folder: str) -> DataFrame:
    made = report.best_models(report.summary(metric_rows(spark, folder)))
    return made.select("experiment_key", "evaluation", "model", "best_symbol", *[rounded(c, 3).alias(c) for c in _BEST_COLUMNS])


@query(
    "h10_winner_agreement",
    sql.summary() + """, wide AS (SELECT experiment_key, max(CASE WHEN evaluation = 'holdout' THEN model END) AS holdout,
    max(CASE WHEN evaluation = 'walk_forward' THEN model END) AS walk_forward FROM best GROUP BY 1)
    SELECT *, holdout = walk_forward AS consistent FROM wide WHERE holdout IS NOT NULL AND walk_forward IS NOT NULL""",
)
def h10_winner_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return report.winner_agreement(report.best_models(report.summary(metric_rows(spark, folder))))


@query(
    "h11_model_delta",
    sql.metrics() + f""" SELECT count(*) AS pairs, {RND('avg(m.rmse - b.rmse)', 4)} AS rmse_delta, {RND('avg(m.smape - b.smape)', 6)} AS smape_delta
    FROM metrics m JOIN metrics b USING (experiment_key, symbol, evaluation) WHERE m.model = 'linear_regression' AND b.model = 'arima'""",
)
def h11_model_delta(spark: SparkSession, folder: str) -> DataFrame:
    made = report.model_delta(metric_rows(spark, folder), "linear_regression", "arima")
    return made.select("pairs", rounded("rmse_delta", 4).alias("rmse_delta"), rounded("smape_delta", 6).alias("smape_delta"))


_CASE = f"experiment_key, evaluation, model, symbol, {RND('rmse', 3)} AS rmse"
_TIES = "experiment_key, evaluation, model, symbol"


@query("h12_worst_rows", sql.metrics() + f" SELECT {_CASE} FROM (SELECT * FROM metrics WHERE model IN ('arima', 'garch_return') ORDER BY rmse DESC, {_TIES} LIMIT 3)")
def h12_worst_rows(spark: SparkSession, folder: str) -> DataFrame:
    made = report.worst_rows(metric_rows(spark, folder, horizons=(1, 5)).where("rmse is not null"), ["arima", "garch_return"])
    return made.select("experiment_key", "evaluation", "model", "symbol", rounded("rmse", 3).alias("rmse"))


@query(
    "h13_top_and_bottom",
    sql.metrics() + f""" SELECT {_CASE}, 'top' AS side FROM (SELECT * FROM metrics WHERE evaluation = 'holdout' ORDER BY rmse, {_TIES} LIMIT 5)
    UNION ALL SELECT {_CASE}, 'bottom' FROM (SELECT * FROM metrics WHERE evaluation = 'holdout'
      ORDER BY rmse DESC, experiment_key DESC, evaluation DESC, model DESC, symbol DESC LIMIT 5)""",
)
def h13_top_and_bottom(spark: SparkSession, folder: str) -> DataFrame:
    made = report.top_and_bottom(metric_rows(spark, folder))
    return made.select("experiment_key", "evaluation", "model", "symbol", rounded("rmse", 3).alias("rmse"), "side")


@query("h14_error_by_step", sql.predictions() + f" SELECT step, {RND('avg(abs_error)', 3)} AS abs_error FROM predictions WHERE evaluation = 'walk_forward' GROUP BY 1")
def h14_error_by_step(spark: SparkSession, folder: str) -> DataFrame:
    return report.error_by_step(predictions(spark, folder)).select("step", rounded("abs_error", 3).alias("abs_error"))


_WIDE_ID = [c for c in report.COMPARISON_KEYS]
_PREDS = [f"{k}_{m}" for m in COMPARED for k in ("pred", "abs_error")]
_HITS = [f"dir_correct_{m}" for m in COMPARED]


@query("h15_comparison", sql.compared(COMPARED) + f" SELECT {', '.join(_WIDE_ID + _HITS)}, {sql.rounded_columns(_PREDS, 2)} FROM compared")
def h15_comparison(spark: SparkSession, folder: str) -> DataFrame:
    made = report.comparison(predictions(spark, folder), COMPARED)
    return made.select(*_WIDE_ID, *_HITS, *[rounded(c, 2).alias(c) for c in _PREDS])


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    return report.extreme_moves(report.comparison(predictions(spark, folder), COMPARED))


_EVENT_ID = ["experiment_key", "symbol", "evaluation", "feature_date", "target_date", "is_extreme_volatility"]


@query("h16_extreme_moves", sql.flagged(COMPARED) + f" SELECT {', '.join(_EVENT_ID)}, {RND('abs_return_1d', 6)} AS abs_return_1d FROM flagged")
def h16_extreme_moves(spark: SparkSession, folder: str) -> DataFrame:
    return _flagged(spark, folder).select(*_EVENT_ID, rounded("abs_return_1d", 6).alias("abs_return_1d"))


_RUN = "PARTITION BY experiment_key, evaluation, symbol ORDER BY target_date"


@query(
    "h17_event_ids",
    sql.flagged(COMPARED) + f""", started AS (SELECT *, (is_extreme_volatility AND NOT coalesce(lag(is_extreme_volatility) OVER w, false))::INTEGER AS start
    FROM flagged WINDOW w AS ({_RUN})),
    counted AS (SELECT *, sum(start) OVER ({_RUN} ROWS UNBOUNDED PRECEDING) AS event FROM started)
    SELECT {', '.join(_EVENT_ID)}, CASE WHEN is_extreme_volatility THEN printf('%s-%s-EV%03d', symbol, evaluation, event::BIGINT) END AS event_id FROM counted""",
)
def h17_event_ids(spark: SparkSession, folder: str) -> DataFrame:
    return report.event_ids(_flagged(spark, folder)).select(*_EVENT_ID, "event_id")


@query(
    "h2_forecast_counts",
    sql.predictions() + f" SELECT {sql.METRIC_KEYS}, count(*) AS row_count, count(predicted) AS forecast_count FROM predictions GROUP BY ALL",
)
def h2_forecast_counts(spark: SparkSession, folder: str) -> DataFrame:
    return forecast_counts(predictions(spark, folder))


@query("h18_leaderboard", sql.metrics() + f" SELECT {sql.METRIC_KEYS}, {metric_output_sql(['rmse', 'mae'])} FROM metrics ORDER BY experiment_key, evaluation, rmse, mae")
def h18_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    made = report.leaderboard([metric_rows(spark, folder, horizons=(h,)) for h in (1, 5)])
    return metric_output(made, list(METRIC_KEYS), ["rmse", "mae"])


@query("a9_result_sinks", sql.predictions() + " SELECT experiment_key, model, evaluation, symbol, target_date, actual_close FROM predictions")
def a9_result_sinks(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "results")
    for horizon in (1, 5):
        sinks.write_results(predictions(spark, folder, horizons=(horizon,)), path)
    return sinks.read_results(spark, path).select("experiment_key", "model", "evaluation", "symbol", "target_date", "actual_close")


@query(
    "a10_h19_combined_tables",
    sql.predictions() + """ SELECT experiment_key, model, evaluation, symbol, step, feature_date, target_date, NULL::VARCHAR AS note FROM predictions WHERE prediction_horizon = 1
    UNION ALL SELECT experiment_key, model, evaluation, symbol, step, feature_date, NULL, 'late' FROM predictions WHERE prediction_horizon = 5""",
)
def a10_h19_combined_tables(spark: SparkSession, folder: str) -> DataFrame:
    """CSV outputs of two runs with different columns in different order in one tree, gathered into one table."""
    path = new_path(spark, "runs")
    keys = ["experiment_key", "model", "evaluation", "symbol", "step", "feature_date"]
    one, two = (predictions(spark, folder, horizons=(h,)) for h in (1, 5))
    one.select(*keys, "target_date").write.option("header", True).csv(f"{path}/one")
    two.select(F.lit("late").alias("note"), *reversed(keys)).write.option("header", True).csv(f"{path}/two")
    made = files.read_tables(spark, [path], ["feature_date", "target_date"])
    return made.withColumn("step", F.col("step").cast("int")).select(*keys, "target_date", "note")


_EXPERIMENTS = ("adjclose_h1_w20", "adjclose_h5_w20")


@query(
    "h20_error_grid",
    sql.metrics() + " SELECT evaluation, model, " + ", ".join(
        f"round(avg(CASE WHEN experiment_key = '{e}' THEN rmse END), 3) AS {e}" for e in _EXPERIMENTS
    ) + " FROM metrics GROUP BY 1, 2",
)
def h20_error_grid(spark: SparkSession, folder: str) -> DataFrame:
    made = report.error_grid(metric_rows(spark, folder))
    return made.select("evaluation", "model", *[rounded(e, 3).alias(e) for e in _EXPERIMENTS])


@query("h21_direction_means", sql.metrics() + " SELECT evaluation, model, " + ", ".join(f"{RND(f'avg({c})', 6)} AS {c}" for c in ("da", "up_f1", "down_f1")) + " FROM metrics GROUP BY 1, 2")
def h21_direction_means(spark: SparkSession, folder: str) -> DataFrame:
    made = report.direction_means(metric_rows(spark, folder))
    return made.select("evaluation", "model", *[rounded(c, 6).alias(c) for c in ("da", "up_f1", "down_f1")])


@query("h22_training_curve")
def h22_training_curve(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate log of the order search stands in for epochs."""
    log = ar.select_order(ar.lagged_panel(split_panel(spark, folder)))
    rows = log.withColumns({"phase": F.lit("selection"), "model": F.lit("arima")})
    made = report.training_curve(rows, "ordinal", "rmse")
    return made.select("model", "ordinal", rounded("mean_rmse", 3).alias("mean_rmse"), rounded("std_rmse", 3).alias("std_rmse"))


_DESCENT = iterative.Descent(penalty=0.05, epochs=40, patience=5)
_SIZE = _DESCENT.rate / 2
_CUT = _SIZE * _DESCENT.penalty * _DESCENT.mix
_SHRINK = 1 + _SIZE * _DESCENT.penalty * (1 - _DESCENT.mix)


def _moments_sql(name: str, where: str) -> str:
    """Means and covariances of the two clipped columns and the target."""
    return f""", {name} AS (SELECT symbol, avg(x1) AS m1, avg(x2) AS m2, avg(target) AS my, var_pop(x1) AS c11, var_pop(x2) AS c22, var_pop(target) AS cyy,
      covar_pop(x1, x2) AS c12, covar_pop(x1, target) AS c1y, covar_pop(x2, target) AS c2y FROM ready WHERE {where} GROUP BY 1)"""


def _step_sql(at: str, other: str, cross: str, w: str) -> str:
    moved = f"({at} - {_SIZE} * ({at} + {w} * {other} - {cross}))"
    return f"sign({moved}) * greatest(abs({moved}) - {_CUT}, 0) / {_SHRINK}"


_UNITS = "sqrt(t.c11) AS u1, sqrt(t.c22) AS u2, sqrt(t.cyy) AS uy, t.c12 / sqrt(t.c11 * t.c22) AS r12, t.c1y / sqrt(t.c11 * t.cyy) AS r1y, t.c2y / sqrt(t.c22 * t.cyy) AS r2y"
_LOSS = "((dy - w1 * d1 - w2 * d2) ** 2 + vyy - 2 * w1 * v1y - 2 * w2 * v2y + w1 * w1 * v11 + w2 * w2 * v22 + 2 * w1 * w2 * v12)"
_EPOCHS = (
    "WITH RECURSIVE " + CLIPPED_TWO.removeprefix("WITH ") + _moments_sql("t", "split = 'train'") + _moments_sql("v", "split = 'validation'") + _moments_sql("b", "split <> 'test'")
    + f""", units AS (SELECT symbol, {_UNITS} FROM t),
    scaled AS (SELECT u.*, (v.m1 - t.m1) / u1 AS d1, (v.m2 - t.m2) / u2 AS d2, (v.my - t.my) / uy AS dy, v.c11 / u1 ** 2 AS v11, v.c22 / u2 ** 2 AS v22, v.cyy / uy ** 2 AS vyy,
      v.c12 / (u1 * u2) AS v12, v.c1y / (u1 * uy) AS v1y, v.c2y / (u2 * uy) AS v2y FROM units u JOIN t USING (symbol) JOIN v USING (symbol)),
    epochs AS (SELECT symbol, 0 AS epoch, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, dy ** 2 + vyy AS loss, dy ** 2 + vyy AS best, 0 AS best_epoch FROM scaled
      UNION ALL SELECT symbol, epoch, w1, w2, loss, CASE WHEN loss < best - {_DESCENT.least} THEN loss ELSE best END, CASE WHEN loss < best - {_DESCENT.least} THEN epoch ELSE best_epoch END
      FROM (SELECT *, {_LOSS} AS loss FROM (SELECT s.*, e.epoch + 1 AS epoch, e.best, e.best_epoch, {_step_sql('e.w1', 'r12', 'r1y', 'e.w2')} AS w1, {_step_sql('e.w2', 'r12', 'r2y', 'e.w1')} AS w2
        FROM epochs e JOIN scaled s USING (symbol) WHERE e.epoch < {_DESCENT.epochs} AND e.epoch - e.best_epoch < {_DESCENT.patience}) moved) judged)"""
)


@query("h22_epoch_curve", _EPOCHS + f" SELECT 'elastic_net' AS model, epoch, {RND('avg(loss)', 5)} AS mean_loss, {RND('coalesce(stddev_samp(loss), 0)', 5)} AS std_loss FROM epochs GROUP BY 2")
def h22_epoch_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Validation loss by epoch of elastic-net fits by gradient steps, each symbol until it stops."""
    model, _ = iterative.clipped_descent(samples(spark, folder), ["close", "volume"], _DESCENT)
    made = report.training_curve(iterative.epoch_log(model, "elastic_net"), "epoch", "loss")
    return made.select("model", "epoch", rounded("mean_loss", 5).alias("mean_loss"), rounded("std_loss", 5).alias("std_loss"))


@query(
    "h22_early_stopped_forecast",
    _EPOCHS + f""", wanted AS (SELECT symbol, arg_max(best_epoch, epoch) AS n FROM epochs GROUP BY 1), merged AS (SELECT symbol, {_UNITS.replace('t.', 'b.')} FROM b),
    again AS (SELECT symbol, 0 AS epoch, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM merged
      UNION ALL SELECT symbol, a.epoch + 1, {_step_sql('a.w1', 'r12', 'r1y', 'a.w2')}, {_step_sql('a.w2', 'r12', 'r2y', 'a.w1')} FROM again a JOIN merged USING (symbol) JOIN wanted USING (symbol) WHERE a.epoch < n),
    final AS (SELECT a.symbol, w1 * uy / u1 AS w1, w2 * uy / u2 AS w2 FROM again a JOIN merged USING (symbol) JOIN wanted USING (symbol) WHERE epoch = n),
    scored AS (SELECT r.*, b.my + l.w1 * (x1 - b.m1) + l.w2 * (x2 - b.m2) AS predicted FROM ready r JOIN final l USING (symbol) JOIN b USING (symbol) WHERE split = 'test') SELECT {FORECAST} FROM scored""",
)
def h22_early_stopped_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows by the elastic net refitted to train and validation for the epochs chosen on validation."""
    return forecast_rows(iterative.descent_holdout(samples(spark, folder), ["close", "volume"], _DESCENT))


@query(
    "h22_metric_spread",
    sql.metrics() + f""" SELECT model, prediction_horizon, {RND('avg(smape)', 6)} AS mean_smape, {RND('coalesce(stddev_samp(smape), 0)', 6)} AS std_smape
    FROM metrics WHERE evaluation = 'holdout' GROUP BY 1, 2""",
)
def h22_metric_spread(spark: SparkSession, folder: str) -> DataFrame:
    rows = metric_rows(spark, folder).withColumn("phase", F.col("evaluation"))
    made = report.training_curve(rows, "prediction_horizon", "smape", phase="holdout")
    return made.select("model", "prediction_horizon", rounded("mean_smape", 6).alias("mean_smape"), rounded("std_smape", 6).alias("std_smape"))


@query(
    "h23_example_series",
    sql.metrics() + f""", means AS (SELECT experiment_key, model, avg(rmse) AS m FROM metrics WHERE evaluation = 'holdout' GROUP BY 1, 2),
    firsts AS (SELECT experiment_key, arg_min(model, (m, model)) AS model FROM means GROUP BY 1 ORDER BY 1 LIMIT 4),
    picks AS (SELECT experiment_key, model, arg_min(symbol, (rmse, symbol)) AS symbol FROM metrics JOIN firsts USING (experiment_key, model) WHERE evaluation = 'holdout' GROUP BY 1, 2)
    SELECT experiment_key, model, symbol, target_date, actual_close, {RND('predicted', 2)} AS predicted FROM predictions JOIN picks USING (experiment_key, model, symbol) WHERE evaluation = 'holdout'""",
)
def h23_example_series(spark: SparkSession, folder: str) -> DataFrame:
    made = report.example_series(metric_rows(spark, folder), predictions(spark, folder))
    return made.withColumn("predicted", rounded("predicted", 2))


@query(
    "h24_primary_subset",
    sql.predictions() + """ SELECT experiment_key, evaluation, model, count(*) AS n FROM predictions WHERE model IN ('arima', 'garch_return') GROUP BY 1, 2, 3""",
)
def h24_primary_subset(spark: SparkSession, folder: str) -> DataFrame:
    kept = report.primary_subset(predictions(spark, folder), COMPARED)
    return kept.groupBy("experiment_key", "evaluation", "model").agg(F.count("*").alias("n"))


_PRIMARY = ("arima", "garch_return")


@query(
    "h24_primary_comparison",
    sql.compared(_PRIMARY) + f" SELECT {', '.join(_WIDE_ID)}, {', '.join(f'dir_correct_{m}' for m in _PRIMARY)}, {sql.rounded_columns([f'pred_{m}' for m in _PRIMARY], 2)} FROM compared",
)
def h24_primary_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The primary models side by side, per experiment, evaluation and symbol."""
    made = report.comparison(report.primary_subset(predictions(spark, folder), COMPARED), _PRIMARY)
    return made.select(*_WIDE_ID, *[f"dir_correct_{m}" for m in _PRIMARY], *[rounded(f"pred_{m}", 2).alias(f"pred_{m}") for m in _PRIMARY])


@query("h25_largest_symbols", sql.panel() + " SELECT symbol, count(*) AS rows FROM panel GROUP BY 1 ORDER BY rows DESC, symbol LIMIT 2")
def h25_largest_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return report.largest_symbols(panel(spark, folder))


@query(
    "h26_run_audit",
    sql.predictions() + """, runs AS (SELECT DISTINCT experiment_key, model FROM predictions), state AS (SELECT g.*, r.experiment_key IS NOT NULL AS there FROM
      (SELECT e AS experiment_key, m AS model FROM (VALUES ('adjclose_h1_w20'), ('adjclose_h5_w20'), ('adjclose_h5_w60')) a(e), (VALUES ('arima'), ('garch_return'), ('linear_regression')) b(m)) g
      LEFT JOIN runs r USING (experiment_key, model))
    SELECT count(*) AS expected, count(*) FILTER (WHERE there AND model <> 'garch_return') AS finished, count(*) FILTER (WHERE there AND model = 'garch_return') AS failed,
      count(*) FILTER (WHERE NOT there) AS missing, false AS complete FROM state""",
)
def h26_run_audit(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["experiment_key", "model"]
    rows = [(e, m) for e in (*_EXPERIMENTS, "adjclose_h5_w60") for m in COMPARED]
    grid = spark.createDataFrame(rows, "experiment_key string, model string")
    status = predictions(spark, folder).select(*keys).distinct().withColumns(
        {"status": F.when(F.col("model") == "garch_return", "failed").otherwise("done"), "attempt": F.lit(1)}
    )
    return report.run_audit(grid, status, keys)


@query(
    "h27_conclusion_rows",
    sql.summary() + f""" SELECT experiment_key, evaluation, model, best_symbol, {sql.rounded_columns(['mean_rmse', 'mean_mae'], 3)}, {sql.rounded_columns(['mean_smape', 'mean_da', 'mean_up_f1', 'mean_down_f1'], 5)} FROM best""",
)
def h27_conclusion_rows(spark: SparkSession, folder: str) -> DataFrame:
    made = report.best_models(report.summary(metric_rows(spark, folder)))
    large, small = ["mean_rmse", "mean_mae"], ["mean_smape", "mean_da", "mean_up_f1", "mean_down_f1"]
    return made.select(
        "experiment_key", "evaluation", "model", "best_symbol", *[rounded(c, 3).alias(c) for c in large], *[rounded(c, 5).alias(c) for c in small]
    )
