import pytest
from pyspark.sql import functions as F

from panelcast.operators import report

METRICS = "symbol string, model string, evaluation string, experiment_key string, mae double, rmse double, smape double, da double, up_precision double, up_recall double, up_f1 double, down_precision double, down_recall double, down_f1 double"


def metric(symbol, model, evaluation, rmse, key="k", da=None):
    return (symbol, model, evaluation, key, rmse / 2, rmse, rmse / 10, da, None, None, None, None, None, None)


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [
        metric("AAA", "linear", "holdout", 1.0, da=0.5), metric("BBB", "linear", "holdout", 3.0), metric("CCC", "linear", "holdout", 3.0),
        metric("AAA", "arima", "holdout", 2.0), metric("BBB", "arima", "holdout", 2.0000001), metric("CCC", "arima", "holdout", 3.0),
        metric("AAA", "arima", "walk_forward", 1.0), metric("AAA", "linear", "walk_forward", 2.0),
        metric("DDD", "linear", "holdout", float("nan")), metric("EEE", "linear", "holdout", float("inf")),
    ]
    return spark.createDataFrame(rows, METRICS)


def test_summary_ranks_and_ties(metrics):
    table = report.ranked(report.summary(metrics))
    rows = {(r.evaluation, r.model): r for r in table.collect()}
    linear, arima = rows[("holdout", "linear")], rows[("holdout", "arima")]
    assert (linear["count"], linear.mean_rmse, linear.median_rmse, linear.mean_da) == (3, 2.333333, 3.0, 0.5)
    assert (linear.best_symbol, linear.worst_symbol) == ("AAA", "CCC")
    assert arima.mean_rmse == 2.333333 and arima.rank == linear.rank == 1
    best = {r.evaluation: r.model for r in report.best_models(table).collect()}
    assert best == {"holdout": "arima", "walk_forward": "arima"}
    agreed = report.winner_agreement(report.best_models(table)).collect()
    assert [(r.holdout, r.walk_forward, r.consistent) for r in agreed] == [("arima", "arima", True)]


def test_delta_and_extremes(metrics):
    d = report.model_delta(metrics.where("symbol in ('AAA', 'BBB')"), "linear", "arima").first()
    assert d.pairs == 3 and d.rmse_delta == pytest.approx((-1.0 + 0.9999999 + 1.0) / 3)
    assert [r.symbol for r in report.worst_rows(report.usable_metrics(metrics), ["linear"]).collect()] == ["BBB", "CCC", "AAA"]
    both = report.top_and_bottom(report.usable_metrics(metrics)).collect()
    assert [r.side for r in both].count("top") == 5 and len(both) == 10


COMPARED = "experiment_key string, evaluation string, symbol string, date timestamp_ntz, feature_date timestamp_ntz, target_date timestamp_ntz, current_close double, actual_close double, split_start_date timestamp_ntz, prediction_horizon int, window_size int, price_column string"


def series(spark, symbol, flags):
    """One row per day; extreme days move by half."""
    rows = [(symbol, i, 15.0 if f else 10.0 + i / 1e6) for i, f in enumerate(flags)]
    return spark.createDataFrame(rows, "symbol string, i int, actual_close double").selectExpr(
        "'k' experiment_key", "'holdout' evaluation", "symbol", "cast(dateadd(date'2024-01-01', i) as timestamp_ntz) target_date", "10D current_close", "actual_close"
    )


def test_comparison_and_events_of_two_models(spark):
    rows = spark.sql("""select 'k' experiment_key, 'holdout' evaluation, 'AAA' symbol, m.model, d.* , timestamp_ntz'2024-01-01' split_start_date, 1 prediction_horizon,
      20 window_size, 'adjclose' price_column, d.actual_close + m.shift predicted, abs(m.shift) abs_error, true direction_correct
      from values ('arima', 1D), ('garch-return', -1D) m(model, shift), values
      (timestamp_ntz'2024-01-02', timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-02', 10D, 11D),
      (timestamp_ntz'2024-01-03', timestamp_ntz'2024-01-02', timestamp_ntz'2024-01-03', 11D, 7D) d(date, feature_date, target_date, current_close, actual_close)""")
    wide = report.comparison(rows, ["arima", "garch-return", "absent"])
    flagged = report.event_ids(report.extreme_moves(wide, 0.5)).orderBy("target_date").collect()
    assert len(flagged) == 2 and flagged[0].pred_arima == 12.0 and flagged[1].pred_garch_return == 6.0 and flagged[0].pred_absent is None
    assert [r.is_extreme_volatility for r in flagged] == [False, True]
    assert [r.event_id for r in flagged] == [None, "AAA-holdout-EV001"]


@pytest.mark.parametrize("rows", [2, 3, 1000])
def test_runs_are_numbered_across_block_edges(spark, rows):
    flags = [1, 1, 0, 1, 1, 1, 0, 0, 1, 0, 1]
    df = series(spark, "A", flags).unionByName(series(spark, "B", [0, 1, 1, 1, 1, 1, 0]))
    flagged = df.withColumn("is_extreme_volatility", F.col("actual_close") == 15.0).repartition(3)
    made = report.event_ids(flagged, rows=rows).orderBy("symbol", "target_date").collect()
    got = [r.event_id and r.event_id[-1] for r in made if r.symbol == "A"]
    assert got == ["1", "1", None, "2", "2", "2", None, None, "3", None, "4"]
    assert {r.event_id for r in made if r.symbol == "B"} == {None, "B-holdout-EV001"}


def test_grid_and_audit(spark):
    grid = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "a")], "experiment_key string, model string")
    keys = ["experiment_key", "model"]
    assert report.missing_runs(grid, grid.where("model = 'a'"), keys).collect() == [("k1", "b")]
    status = spark.createDataFrame([("k1", "a", "failed", 1), ("k1", "a", "done", 2), ("k1", "b", "done", 1), ("k2", "a", "done", 1)], "experiment_key string, model string, status string, attempt int")
    assert report.run_audit(grid, status, keys).first()[:] == (3, 3, 0, 0, True)
    assert report.run_audit(grid, status.where("model = 'a'"), keys).first()[:] == (3, 2, 0, 1, False)
