import numpy as np
import pandas as pd
import pytest
from helpers import make_panel, to_spark

from panelcast.operators import splits, two_stage

SIZES = {"HOT": 120, "B": 90}
LONG = 4


@pytest.fixture(scope="module")
def base(spark):
    panel = to_spark(spark, make_panel(SIZES, seed=9))
    return panel.withColumn("split", splits.date_split(splits.Boundaries("2024-02-19 00:00:00", "2024-03-01 00:00:00"))).cache()


@pytest.fixture(scope="module")
def series(base):
    return {s: p.sort_values("seq").reset_index(drop=True) for s, p in base.toPandas().groupby("symbol")}


def stages(d, p, q, long_terms=LONG):
    """One-step forecasts of all changes by an order fitted on ``d``; d[0] is missing. Also the forecast after the last."""
    n = len(d)
    e = np.full(n, np.nan)
    if q:
        rows = range(long_terms + 1, n)
        b = np.linalg.lstsq(np.array([[d[t - i] for i in range(1, long_terms + 1)] for t in rows]), d[long_terms + 1 :], rcond=None)[0]
        for t in rows:
            e[t] = d[t] - b @ [d[t - i] for i in range(1, long_terms + 1)]

    def terms(t):
        return [d[t - i] for i in range(1, p + 1)] + [e[t - j] for j in range(1, q + 1)]

    deep = (long_terms + q if q else p) + 1
    w = np.linalg.lstsq(np.array([terms(t) for t in range(deep, n)]), d[deep:], rcond=None)[0]
    guess = np.full(n + 1, np.nan)
    for t in range(deep, n + 1):
        guess[t] = w @ terms(t)
    return guess, w, e


@pytest.mark.parametrize("order", [(1, 1, 0), (3, 1, 0), (1, 1, 1), (2, 1, 2)])
@pytest.mark.parametrize("rows", [7, None])
def test_orders_equal_refitting_both_stages_at_every_step(base, series, order, rows):
    p, _, q = order
    made = two_stage.walk_forward_orders(base, two_stage.fixed_order(base, order), long_terms=LONG, deepest=7, rows=rows).collect()
    got, checked = {(r.symbol, r.seq): r.linear_next for r in made}, 0
    for symbol, part in series.items():
        price = part["adjclose"].to_numpy()
        for t in np.flatnonzero(part["split"] == "test"):
            d = np.concatenate([[np.nan], np.diff(price[: t + 1])])
            assert got[(symbol, t + 1)] == pytest.approx(price[t] + stages(d, p, q)[0][-1], rel=1e-8)
            checked += 1
    assert checked == len(made) > 60


def test_later_steps_feed_on_earlier_forecasts(base, series):
    made = {(r.symbol, r.seq): r.linear_next for r in two_stage.walk_forward_orders(base, two_stage.fixed_order(base, (2, 1, 1)), 3, long_terms=LONG, deepest=7).collect()}
    for symbol, part in series.items():
        price = part["adjclose"].to_numpy()
        t = int(np.flatnonzero(part["split"] == "test")[10])
        d = np.concatenate([[np.nan], np.diff(price[: t + 1])])
        _, w, e = stages(d, 2, 1)
        past, error, level = [d[t], d[t - 1]], e[t], price[t]
        for _ in range(3):
            step = w @ [*past, error]
            level, past, error = level + step, [step, past[0]], 0.0
        assert made[(symbol, t + 1)] == pytest.approx(level, rel=1e-8)


@pytest.mark.parametrize("order, columns, rows", [((1, 1, 0), [], 9), ((2, 1, 0), ["volume"], None), ((1, 1, 1), ["close"], 16)])
def test_hybrid_equals_recomputing_all_residuals_at_every_step(base, series, order, columns, rows):
    window, (p, _, q) = 3, order
    made = two_stage.walk_forward_hybrid(base, columns, window, two_stage.fixed_order(base, order), long_terms=LONG, deepest=7, rows=rows).collect()
    got, checked = {(r.symbol, r.seq): r.predicted for r in made}, 0
    deep = 7 + window
    for symbol, part in series.items():
        price = part["adjclose"].to_numpy()
        past = part["split"] != "test"
        f = part[columns].clip(part[columns][past].quantile(0.01), part[columns][past].quantile(0.99), axis=1).to_numpy() if columns else np.zeros((len(part), 0))
        for t in np.flatnonzero(part["split"] == "test"):
            d = np.concatenate([[np.nan], np.diff(price[: t + 1])])
            guess = stages(d, p, q)[0]
            r = d - guess[:-1]
            row = lambda s: np.concatenate([[1.0], r[s - window + 1 : s + 1], f[s - window + 1 : s + 1].ravel()])  # noqa: E731, B023
            rows_ = range(deep, t)
            x, y = np.array([row(s) for s in rows_]), r[deep + 1 : t + 1]
            want = price[t] + guess[-1] + row(t) @ np.linalg.lstsq(x, y, rcond=None)[0]
            assert got[(symbol, t + 1)] == pytest.approx(want, rel=1e-7)
            checked += 1
    assert checked == len(made) > 60


def test_symbols_with_own_orders_and_short_history(spark, base):
    short = to_spark(spark, pd.concat([make_panel({"S": 5}), make_panel({"T": 60}, seed=2)]))
    panel = short.withColumn("split", splits.date_split(splits.Boundaries("2024-01-02 00:00:00", "2024-01-03 00:00:00")))
    orders = spark.createDataFrame([("S", 1, 0), ("T", 2, 1)], "symbol string, p int, q int")
    made = two_stage.walk_forward_orders(panel, orders, long_terms=LONG, deepest=7).collect()
    assert {r.symbol for r in made} == {"T"} and len(made) > 40
    chosen = two_stage.selected_orders(base)
    assert chosen.count() == len(SIZES)
    assert two_stage.walk_forward_orders(base, chosen).count() == base.where("split = 'test'").count()
