import numpy as np
import pandas as pd
import pytest
from helpers import make_panel, to_spark

from panelcast.operators import sequence, splits, transforms

COLS = ["close", "volume"]
W = 3


@pytest.fixture(scope="module")
def base(spark):
    panel = to_spark(spark, make_panel({"HOT": 120, "B": 80}, seed=4))
    return panel.withColumn("split", splits.date_split(splits.Boundaries("2024-02-19 00:00:00", "2024-03-01 00:00:00"))).cache()


@pytest.fixture(scope="module")
def samples(base):
    return splits.supervised_positions(splits.supervised(base, 1), base, 1).cache()


@pytest.fixture(scope="module")
def windows(samples):
    scaled = transforms.fit_and_scale(splits.merged_for_refit(samples), COLS).toPandas().sort_values(["symbol", "pos"])
    made = {}
    for symbol, part in scaled.groupby("symbol"):
        v = part[COLS].to_numpy()
        x = np.array([v[i - W + 1 : i + 1].ravel() for i in range(W - 1, len(v))])
        made[symbol] = (x, part["target"].to_numpy()[W - 1 :], part["split"].to_numpy()[W - 1 :], part["step"].to_numpy()[W - 1 :])
    return made


def fit(x, y, row):
    a = np.column_stack([np.ones(len(x)), x])
    return np.concatenate([[1.0], row]) @ np.linalg.lstsq(a, y, rcond=None)[0]


def test_holdout(samples, windows):
    made = {(r.symbol, r.step): r.predicted for r in sequence.holdout(samples, COLS, W).collect()}
    for symbol, (x, y, split, step) in windows.items():
        train = split == "train"
        for i in np.flatnonzero(split == "test"):
            assert made[(symbol, step[i])] == pytest.approx(fit(x[train], y[train], x[i]), rel=1e-5)


@pytest.mark.parametrize("rows", [4, 1000])
def test_walk_forward(samples, windows, rows):
    made = {(r.symbol, r.step): r.predicted for r in sequence.walk_forward(samples, COLS, W, rows=rows).collect()}
    for symbol, (x, y, split, step) in windows.items():
        for i in np.flatnonzero(split == "test"):
            assert made[(symbol, step[i])] == pytest.approx(fit(x[:i], y[:i], x[i]), rel=1e-5)


def test_pooled_uses_all_symbols(samples, windows):
    made = sequence.pooled_holdout(samples, COLS, W)
    assert made.count() == sum((s == "test").sum() for _, _, s, _ in windows.values())
    assert made.where("abs(predicted / current_close - 1) > 0.2").count() == 0


def hybrid_table(part):
    """Linear part, residual and clipped features of one symbol; fitted on train and validation."""
    price, split = part["adjclose"].to_numpy(), part["split"].to_numpy()
    d = np.concatenate([[0.0], np.diff(price)])
    known = np.flatnonzero(split != "test")[2:]
    phi = (d[known] @ d[known - 1]) / (d[known - 1] @ d[known - 1])
    linear_next = price + phi * d
    residual = np.concatenate([[np.nan], price[1:] - linear_next[:-1]])
    last = [i for i in range(1, len(price) - 1) if split[i] == split[i + 1]]
    table = pd.DataFrame(
        {
            "split": np.where(split[last] == "test", "test", "train"), "residual": residual[last], "close": part["close"].to_numpy()[last],
            "next": linear_next[last], "y": residual[np.array(last) + 1], "date": part["date"].to_numpy()[last],
        }
    )
    train = table["split"] == "train"
    for c in ("residual", "close"):
        table[c] = table[c].clip(table[c][train].quantile(0.01), table[c][train].quantile(0.99))
    return table


def test_residual_hybrid_matches_brute_force(base):
    made = {(r.symbol, r.feature_date): r.predicted for r in sequence.residual_hybrid(base, ["close"], W).collect()}
    checked = 0
    for symbol, part in base.toPandas().sort_values(["symbol", "seq"]).groupby("symbol"):
        t = hybrid_table(part.reset_index(drop=True))
        v = t[["residual", "close"]].to_numpy()
        x = np.array([v[i - W + 1 : i + 1].ravel() for i in range(W - 1, len(v))])
        rest = t.iloc[W - 1 :].reset_index(drop=True)
        train = (rest["split"] == "train").to_numpy()
        for i in np.flatnonzero(~train):
            want = rest["next"][i] + fit(x[train], rest["y"].to_numpy()[train], x[i])
            assert made[(symbol, rest["date"][i].to_pydatetime())] == pytest.approx(want, rel=1e-5)
            checked += 1
    assert checked == len(made)
