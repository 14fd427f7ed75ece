import numpy as np
import pandas as pd
import pytest
from helpers import make_panel, to_spark

from panelcast.operators import iterative, splits
from panelcast.operators.regression import fit_linear

COLUMNS = ["close", "volume"]


@pytest.fixture(scope="module")
def samples(spark):
    panel = to_spark(spark, make_panel({"HOT": 160, "B": 60, "C": 50}))
    base = panel.withColumn("split", splits.date_split(splits.Boundaries("2024-01-30 00:00:00", "2024-02-08 00:00:00")))
    return splits.supervised_positions(splits.supervised(base, 1), base, 1).cache()


def plain(frame, how):
    """Epoch by epoch over the rows themselves."""
    train, held = frame[frame.split == "train"], frame[frame.split == "validation"]
    mean, unit = train[[*COLUMNS, "target"]].mean().to_numpy(), train[[*COLUMNS, "target"]].std(ddof=0).to_numpy()
    t, v = ((part[[*COLUMNS, "target"]].to_numpy() - mean) / unit for part in (train, held))
    w, log = np.zeros(len(COLUMNS)), []
    for _ in range(how.epochs + 1):
        log.append(float(np.mean((v[:, -1] - v[:, :-1] @ w) ** 2)))
        size = how.rate / len(COLUMNS)
        w = w + size * t[:, :-1].T @ (t[:, -1] - t[:, :-1] @ w) / len(t)
        w = np.sign(w) * np.maximum(abs(w) - size * how.penalty * how.mix, 0) / (1 + size * how.penalty * (1 - how.mix))
    best, at, stop = log[0], 0, how.epochs
    for epoch in range(1, how.epochs + 1):
        if log[epoch] < best - how.least:
            best, at = log[epoch], epoch
        if epoch - at >= how.patience:
            stop = epoch
            break
    return at, log[: stop + 1]


@pytest.mark.parametrize("how", [iterative.Descent(epochs=30, patience=4), iterative.Descent(penalty=0.4, mix=0.7, rate=0.6, epochs=25, patience=3)])
def test_epochs_equal_a_plain_loop(samples, how):
    rows = samples.toPandas()
    for r in iterative.fit_descent(samples, COLUMNS, how=how).collect():
        at, log = plain(rows[rows.symbol == r.symbol], how)
        assert r.epochs == at and [x.epoch for x in r.selection] == list(range(len(log)))
        assert np.allclose([x.loss for x in r.selection], log, rtol=1e-8)
        if not how.penalty:  # the plain squared loss is what falls
            assert all(np.diff([x.train_loss for x in r.selection]) <= 1e-12)


def test_many_epochs_reach_the_closed_form(samples):
    how = iterative.Descent(epochs=20_000, patience=20_000, least=-1.0)
    history = samples.where("split <> 'test'")
    closed = {r.symbol: (*r.coefficients, r.intercept) for r in fit_linear(history, COLUMNS).collect()}
    made = {r.symbol: (*r.coefficients, r.intercept) for r in iterative.fit_descent(samples, COLUMNS, how=how).collect()}
    assert made.keys() == closed.keys()
    for symbol, want in closed.items():
        assert np.allclose(made[symbol], want, rtol=1e-6)


def test_edges(spark):
    """No validation rows, a constant column, nulls, one train row, no train row, an empty table."""
    schema = "symbol string, split string, close double, volume double, target double"
    rows = [("A", "train", float(i), 5.0, 2.0 * i) for i in range(9)] + [("A", "train", None, 5.0, 1.0), ("B", "train", 1.0, 1.0, 3.0), ("C", "test", 1.0, 1.0, 1.0)]
    made = {r.symbol: r for r in iterative.fit_descent(spark.createDataFrame(rows, schema), COLUMNS).collect()}
    assert set(made) == {"A", "B"}
    assert made["A"].epochs == iterative.Descent().epochs and np.allclose(made["A"].coefficients, [2.0, 0.0])
    assert made["A"].selection[0].loss is None
    assert made["B"].coefficients == [0.0, 0.0] and made["B"].intercept == 3.0
    assert iterative.fit_descent(spark.createDataFrame([], schema), COLUMNS).collect() == []


def test_log_phases(samples):
    model = iterative.fit_descent(samples, COLUMNS, how=iterative.Descent(epochs=5))
    log = iterative.epoch_log(model, "m").toPandas()
    assert set(log.phase) == {"selection", "refit"} and log[log.phase == "refit"].loss.isna().all()
    assert isinstance(log, pd.DataFrame) and (log.groupby(["symbol", "phase"]).epoch.min() == 0).all()
