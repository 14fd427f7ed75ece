import math

import pytest

from panelcast.operators.evaluate import first_test_dates, forecast_counts, metric_columns, prediction_rows


def scores(spark, actual, predicted, current):
    df = spark.createDataFrame(list(zip(actual, predicted, current)), "target double, predicted double, current_close double")
    return df.agg(*metric_columns()).first()


def test_all_flat_targets_leave_directions_undefined(spark):
    m = scores(spark, [4.0, 5.0], [3.0, 6.0], [4.0, 5.0])
    assert m.direction_count == 0
    assert [m[c] for c in ("da", "up_precision", "up_recall", "up_f1", "down_precision", "down_recall", "down_f1")] == [None] * 7


def test_flat_guesses_are_never_right(spark):
    m = scores(spark, [3.0, 1.0, 2.5], [2.0, 2.0, 2.0], [2.0, 2.0, 2.0])
    assert (m.direction_count, m.da) == (3, 0.0)
    assert (m.up_precision, m.up_recall, m.up_f1) == (None, 0.0, None) and (m.down_precision, m.down_recall, m.down_f1) == (None, 0.0, None)


def test_mixed_directions(spark):
    # four moves up, two down; three guessed up of which two are right, three guessed down of which one is right
    actual = [6.0, 7.0, 8.0, 9.0, 1.0, 2.0]
    guess = [5.5, 5.1, 4.0, 3.0, 4.9, 5.2]
    m = scores(spark, actual, guess, [5.0] * 6)
    assert m.da == pytest.approx(3 / 6)
    assert (m.up_precision, m.up_recall, m.up_f1) == pytest.approx((2 / 3, 2 / 4, 4 / 7))
    assert (m.down_precision, m.down_recall, m.down_f1) == pytest.approx((1 / 3, 1 / 2, 2 / 5))


def test_one_row(spark):
    m = scores(spark, [3.0], [5.0], [4.0])
    assert (m.mae, m.mse, m.rmse, m.smape, m.da, m.down_recall, m.up_precision) == pytest.approx((2.0, 4.0, 2.0, 0.5, 0.0, 0.0, 0.0))


def test_a_missing_forecast_voids_the_errors(spark):
    m = scores(spark, [3.0, 4.0], [3.0, None], [2.0, 2.0])
    assert (m.mae, m.mse, m.rmse, m.smape) == (None,) * 4 and m.direction_count == 2 and m.da == 0.5
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "symbol string, predicted double")
    assert {r.symbol: (r.row_count, r.forecast_count) for r in forecast_counts(df, ("symbol",)).collect()} == {"a": (2, 1), "b": (1, 1)}


def test_errors_and_flat_guesses(spark):
    m = scores(spark, [1.0, -1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0])
    assert (m.mae, m.mse, m.rmse) == pytest.approx((2 / 3, 4 / 3, math.sqrt(4 / 3)))
    assert m.smape == pytest.approx((0 + 2 * 2 / 2 + 0) / 3)
    flat = scores(spark, [2.0], [1.0], [1.0])
    assert (flat.da, flat.up_precision, flat.up_recall) == (0.0, None, 0.0)


def test_prediction_rows(spark):
    df = spark.sql("""select 'A' symbol, 1L step, timestamp_ntz'2024-01-01' feature_date, timestamp_ntz'2024-01-02' target_date, 10D current_close, 11D target, 12D predicted
      union all select 'A', 2L, timestamp_ntz'2024-01-02', timestamp_ntz'2024-01-03', 11D, 11D, 12D
      union all select 'A', 3L, timestamp_ntz'2024-01-03', timestamp_ntz'2024-01-04', 11D, 12D, cast(null as double)""")
    made = prediction_rows(df, first_test_dates(df.selectExpr("*", "'test' as split")), model="m", evaluation="holdout", feature_count=1, feature_set="f", horizon=1, window=20).orderBy("step")
    assert len(made.columns) == 19
    rows = made.collect()
    assert [r.direction_correct for r in rows] == [True, None, None]
    assert [r.abs_error for r in rows] == [1.0, 1.0, None]
    assert {str(r.split_start_date) for r in rows} == {"2024-01-01 00:00:00"} and rows[0].experiment_key == "adjclose_h1_w20"
