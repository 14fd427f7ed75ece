import numpy as np
import pytest
from helpers import make_panel, to_spark
from pyspark.sql import functions as F

from panelcast.operators import autoregression as ar
from panelcast.operators import splits

SIZES = {"HOT": 150, "B": 70}


@pytest.fixture(scope="module")
def base(spark):
    panel = to_spark(spark, make_panel(SIZES, seed=11))
    return panel.withColumn("split", splits.date_split(splits.Boundaries("2024-02-19 00:00:00", "2024-03-01 00:00:00"))).cache()


@pytest.fixture(scope="module")
def prices(base):
    table = base.toPandas().sort_values(["symbol", "seq"])
    return {s: (p["adjclose"].to_numpy(), p["split"].to_numpy()) for s, p in table.groupby("symbol")}


def design(d, p, q=0, e=None):
    """Rows t with all lags; d[t] is the change into row t (d[0] missing)."""
    rows = [t for t in range(1 + p, len(d)) if q == 0 or not np.isnan(e[t - q])]
    x = np.array([[d[t - i] for i in range(1, p + 1)] + [e[t - j] for j in range(1, q + 1)] for t in rows])
    return rows, x, d[rows]


def changes(price):
    return np.concatenate([[np.nan], np.diff(price)])


@pytest.mark.parametrize("p", [1, 2, 3, 5])
def test_coefficients_match_least_squares(base, prices, p):
    lagged = ar.differenced(base, rows=13)
    fitted = {r.symbol: r.phi for r in ar.fit_orders(lagged.where("split = 'train'"), ((p, 1, 0),)).collect()}
    for symbol, (price, split) in prices.items():
        _, x, y = design(changes(price[split == "train"]), p)
        want = np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose(fitted[symbol][:p], want, rtol=1e-7) and not any(fitted[symbol][p:])


def long_residuals(d, split, m=ar.LONG_TERMS):
    rows = [t for t in range(m + 1, len(d)) if split[t] == "train"]
    x = np.array([[d[t - i] for i in range(1, m + 1)] for t in rows])
    a = np.linalg.lstsq(x, d[rows], rcond=None)[0]
    e = np.full(len(d), np.nan)
    for t in range(m + 1, len(d)):
        e[t] = d[t] - a @ [d[t - i] for i in range(1, m + 1)]
    return e


@pytest.mark.parametrize("order", [(2, 1, 2), (3, 1, 3)])
def test_moving_average_orders_match_two_stage_fit(base, prices, order):
    lagged = ar.lagged_panel(base, (order,))
    fitted = {r.symbol: r.phi for r in ar.fit_orders(lagged.where("split = 'train'"), (order,)).collect()}
    p, _, q = order
    for symbol, (price, split) in prices.items():
        d = changes(price)
        e = long_residuals(d, split)
        keep = split == "train"
        _, x, y = design(d[keep], p, q, e[keep])
        want = np.linalg.lstsq(x, y, rcond=None)[0]
        got = np.array(fitted[symbol])
        assert np.allclose(np.concatenate([got[:p], got[5 : 5 + q]]), want, rtol=1e-5, atol=1e-8)


@pytest.mark.parametrize("horizon", [1, 3])
def test_selection_follows_validation_error(base, prices, horizon):
    orders = ((1, 1, 0), (2, 1, 0), (5, 1, 0))
    log = ar.select_order(ar.lagged_panel(base, orders, horizon=horizon), orders, horizon=horizon).collect()
    for symbol, (price, split) in prices.items():
        d, scores = changes(price), []
        for p, _, _ in orders:
            _, x, y = design(d[split == "train"], p)
            phi = np.linalg.lstsq(x, y, rcond=None)[0]
            errors = []
            for t in np.flatnonzero(split == "validation")[:-horizon]:
                past, level = [d[t - i] for i in range(p)], price[t]
                for _ in range(horizon):
                    step = phi @ past
                    level, past = level + step, [step, *past[:-1]]
                errors.append(price[t + horizon] - level)
            scores.append(np.sqrt(np.mean(np.square(errors))))
        rows = sorted((r for r in log if r.symbol == symbol), key=lambda r: r.ordinal)
        assert np.allclose([r.rmse for r in rows], scores, rtol=1e-8)
        assert [r.best for r in rows].index(True) == int(np.argmin(scores))
        assert [r.selected for r in rows] == [i == 0 or s < min(scores[:i]) for i, s in enumerate(scores)]


def test_symbols_without_validation_take_the_default(spark, base):
    cut = base.where("symbol = 'B' or split <> 'validation'")
    log = ar.select_order(ar.lagged_panel(cut, ((1, 1, 0),)), ((1, 1, 0),))
    row = log.where("symbol = 'HOT'").collect()
    assert [(r.order, r.best) for r in row] == [("(5, 1, 0)", True)]


@pytest.mark.parametrize("p", [1, 3])
@pytest.mark.parametrize("rows", [5, 1000])
def test_walk_forward_refits_on_everything_seen(base, prices, p, rows):
    made = {(r.symbol, r.seq): r.linear_next for r in ar.walk_forward(base, p, rows=rows).collect()}
    for symbol, (price, split) in prices.items():
        for t in np.flatnonzero(split == "test"):
            d = changes(price[: t + 1])
            _, x, y = design(d, p)
            phi = np.linalg.lstsq(x, y, rcond=None)[0]
            want = price[t] + phi @ [d[t - i] for i in range(p)]
            assert made[(symbol, t + 1)] == pytest.approx(want, rel=1e-8)


def test_holdout_parameters_are_frozen_and_blind_to_the_future(base):
    changed = base.withColumn("adjclose", F.when((F.col("split") == "test") & (F.col("seq") > 65), 1.0).otherwise(F.col("adjclose")))
    cols = ["symbol", "seq", F.round("linear_next", 8), F.round("linear_current", 8)]
    a, log = ar.holdout(base, ((1, 1, 0), (2, 1, 0)))
    b, _ = ar.holdout(changed, ((1, 1, 0), (2, 1, 0)))
    assert a.where("seq <= 65").select(*cols).exceptAll(b.where("seq <= 65").select(*cols)).count() == 0
    assert log.where("best").count() == len(SIZES)
