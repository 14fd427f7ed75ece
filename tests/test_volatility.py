import numpy as np
import pytest
from helpers import make_panel, to_spark

from panelcast.operators import splits, volatility as vol


@pytest.fixture(scope="module")
def base(spark):
    panel = to_spark(spark, make_panel({"HOT": 120, "B": 60}, seed=21))
    return panel.withColumn("split", splits.date_split(splits.Boundaries("2024-02-09 00:00:00", "2024-02-19 00:00:00"))).cache()


@pytest.fixture(scope="module")
def prices(base):
    table = base.toPandas().sort_values(["symbol", "seq"])
    return {s: p["adjclose"].to_numpy() for s, p in table.groupby("symbol")}


def ols(x, y, w=None):
    w = np.ones(len(x)) if w is None else np.asarray(w)
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    phi = np.sum(w * (x - mx) * (y - my)) / np.sum(w * (x - mx) ** 2)
    return my - phi * mx, phi


def brute(price, spec):
    """Sequential version: forecast of row t + 1 from rows up to t."""
    r = np.concatenate([[np.nan], 100 * np.diff(np.log(price))])
    n, width = len(r), len(vol.CANDIDATES)
    means = {t: ols(r[1:t], r[2 : t + 1]) for t in range(4, n)}
    shock = np.full(n, np.nan)
    for t in range(5, n):
        c, phi = means[t - 1]
        shock[t] = (r[t] - c - phi * r[t - 1]) ** 2
    h, loss = np.full((n, width), np.nan), np.zeros(width)
    out, plain = {}, {t: price[t] * np.exp((c + phi * r[t]) / 100) for t, (c, phi) in means.items()}
    for t in range(4, n):
        known = shock[5:t]
        if len(known) >= 2:
            level = known.mean()
            for k, (a, b) in enumerate(vol.CANDIDATES):
                if k == 0 and np.isnan(h[t - 1, k]):
                    start, start_level = t, level
                shocks = [start_level if t - i < start else shock[t - i] for i in range(1, spec.p + 1)]
                levels = [start_level if t - j < start else h[t - j, k] for j in range(1, spec.q + 1)]
                h[t, k] = (1 - a - b) * level + a * np.mean(shocks) + b * np.mean(levels)
                loss[k] += 0.5 * (np.log(h[t, k]) + shock[t] / h[t, k])
            rows = np.arange(start, t + 1)
            if len(rows) > 1:
                c, phi = ols(r[rows - 1], r[rows], 1 / h[rows, int(np.argmin(loss))])
                out[t + 1] = price[t] * np.exp((c + phi * r[t]) / 100)
    return plain, out


@pytest.mark.parametrize("spec", [vol.Spec(1, 1), vol.Spec(1, 2), vol.Spec(2, 1)])
@pytest.mark.parametrize("rows", [(16, 32), (1000, 1000)])
def test_forecasts_match_the_sequential_version(base, prices, spec, rows):
    plain = {(r.symbol, r.seq): r.predicted for r in vol.mean_forecast(base, rows=rows[0]).collect()}
    made = {(r.symbol, r.seq): r.predicted for r in vol.forecasts(base, spec, rows=rows[0], filter_rows=rows[1]).collect()}
    for symbol, price in prices.items():
        want_plain, want = brute(price, spec)
        for t, value in want_plain.items():
            assert plain[(symbol, t + 1)] == pytest.approx(value, rel=1e-9)
        assert len(want) > 40
        for seq, value in want.items():
            assert made[(symbol, seq)] == pytest.approx(value, rel=1e-8)


def test_selection_takes_the_smallest_validation_error(base):
    log, chosen = vol.select_spec(base)
    rows = log.collect()
    for symbol in ("HOT", "B"):
        mine = [r for r in rows if r.symbol == symbol]
        assert len(mine) == len(vol.SPECS) and [r.ordinal for r in mine if r.best] == [min(mine, key=lambda r: (r.rmse, r.ordinal)).ordinal]
    assert chosen.where("split <> 'test'").count() == 0 and chosen.count() > 0
    assert chosen.where("target_date <= feature_date").count() == 0


def test_warm_up_follows_the_weights():
    assert vol.warm_up(vol.Spec(1, 1), [(0.1, 0.5)]) == 61
    assert vol.warm_up(vol.Spec(1, 2)) > vol.warm_up(vol.Spec(1, 1)) > 390
    with pytest.raises(ValueError):
        vol.warm_up(vol.Spec(1, 1), [(0.0, 1.0)])


@pytest.mark.parametrize("spec", [vol.Spec(1, 1), vol.Spec(1, 2), vol.Spec(2, 1), vol.Spec(3, 3)])
def test_matrix_steps_equal_the_recursion(spec):
    rng = np.random.default_rng(5)
    shock2, level2 = rng.exponential(1, 500), 1 + rng.random(500)
    level2[:7] = np.nan
    made = vol._filter(shock2, level2, spec)
    assert np.isnan(made[:7]).all()
    for k, (a, b) in enumerate(vol.CANDIDATES):
        h = []
        for i in range(7, 500):
            shocks = [shock2[i - j] if i - j >= 7 else level2[7] for j in range(1, spec.p + 1)]
            levels = [h[-j] if len(h) >= j else level2[7] for j in range(1, spec.q + 1)]
            h.append((1 - a - b) * level2[i] + a * np.mean(shocks) + b * np.mean(levels))
        assert np.allclose(made[7:, k], h, rtol=1e-12)
