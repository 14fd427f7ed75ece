import numpy as np
import pytest
from helpers import make_panel, to_spark
from pyspark.sql import functions as F

from panelcast.operators import regression as reg
from panelcast.operators import splits, transforms
from panelcast.operators.expanding_bounds import walk_forward_refit_bounds

SIX = ["open", "high", "low", "close", "adjclose", "volume"]
SIZES = {"HOT": 160, "B": 60, "C": 50}


@pytest.fixture(scope="module")
def base(spark):
    panel = to_spark(spark, make_panel(SIZES)).cache()
    return panel.withColumn("split", splits.date_split(splits.Boundaries("2024-01-30 00:00:00", "2024-02-08 00:00:00")))


@pytest.fixture(scope="module")
def samples(base):
    return splits.supervised_positions(splits.supervised(base, 1), base, 1).cache()


@pytest.fixture(scope="module")
def table(samples):
    return samples.toPandas().sort_values(["symbol", "pos"])


def lstsq(x, y, row):
    a = np.column_stack([np.ones(len(x)), x])
    return np.concatenate([[1.0], row]) @ np.linalg.lstsq(a, y, rcond=None)[0]


def winsor(history, rows, columns):
    lo, hi = history[columns].quantile(0.01), history[columns].quantile(0.99)
    return history[columns].clip(lo, hi, axis=1).to_numpy(), rows[columns].clip(lo, hi, axis=1).to_numpy()


def test_holdout_matches_least_squares_with_repeated_columns(samples, table):
    made = {(r.symbol, r.step): r.predicted for r in reg.linear_holdout(samples, SIX).collect()}
    for symbol, part in table.groupby("symbol"):
        train, test = part[part["split"] == "train"], part[part["split"] == "test"]
        history = part[part["split"] != "test"]
        lo, hi = train[SIX].quantile(0.01), train[SIX].quantile(0.99)
        x, z = history[SIX].clip(lo, hi, axis=1).to_numpy(), test[SIX].clip(lo, hi, axis=1).to_numpy()
        for row, step in zip(z, test["step"], strict=True):
            assert made[(symbol, step)] == pytest.approx(lstsq(x, history["target"].to_numpy(), row), rel=1e-6)
    assert len(made) == (table["split"] == "test").sum()


def test_scaled_and_unscaled_fits_agree(samples):
    plain = reg.linear_holdout(samples, ["close", "volume"])
    scaled = reg.linear_holdout(transforms.fit_and_scale(samples, ["close", "volume"]), ["close", "volume"], limits=(0.0, 1.0))
    both = plain.alias("a").join(scaled.alias("b"), ["symbol", "step"])
    assert both.agg(F.max(F.abs(F.col("a.predicted") - F.col("b.predicted")))).first()[0] < 1e-8


def test_rows_with_gaps_have_no_forecast(samples):
    holed = samples.withColumn("volume", F.when((F.col("split") != "test") | (F.col("step") != 2), F.col("volume")))
    made = reg.linear_holdout(holed, ["close", "volume"])
    assert {r.step for r in made.where("predicted is null").collect()} == {2}


@pytest.mark.parametrize("horizon, leak_safe", [(1, True), (4, True), (4, False)])
@pytest.mark.parametrize("rows", [3, 1000])
def test_walk_forward_matches_refits(base, horizon, leak_safe, rows):
    samples = splits.supervised_positions(splits.supervised(base, horizon), base, horizon).cache()
    made = {(r.symbol, r.step): r.predicted for r in reg.walk_forward_linear(samples, ["close", "volume"], horizon, limits=None, leak_safe=leak_safe, rows=rows).collect()}
    table = samples.toPandas()
    checked = 0
    for symbol, part in table.groupby("symbol"):
        for r in part[part["split"] == "test"].itertuples():
            known = part[(part["target_date"] <= r.feature_date) if leak_safe else (part["pos"] < r.pos)]
            want = lstsq(known[["close", "volume"]].to_numpy(), known["target"].to_numpy(), np.array([r.close, r.volume]))
            assert made[(symbol, r.step)] == pytest.approx(want, rel=1e-7)
            checked += 1
    assert checked == len(made) > 80


@pytest.mark.parametrize("rows, side", [(7, 2), (16, 4), (None, None)])
@pytest.mark.parametrize("columns, horizon", [(["close"], 1), (["close", "volume"], 3)])
def test_refit_bounds_match_brute_force_at_every_step(base, rows, side, columns, horizon):
    samples = splits.supervised_positions(splits.supervised(base, horizon), base, horizon)
    holed = samples.withColumn("volume", F.when(F.col("pos") % 11 != 5, F.col("volume"))).cache()
    made = {(r.symbol, r.step): r.predicted for r in walk_forward_refit_bounds(holed, columns, horizon, rows=rows, side=side).collect()}
    table, checked = holed.toPandas(), 0
    for symbol, part in table.groupby("symbol"):
        for r in part[part["split"] == "test"].itertuples():
            known = part[part["target_date"] <= r.feature_date]
            x, z = winsor(known, part[part["pos"] == r.pos], columns)
            whole = ~np.isnan(x).any(axis=1)
            got = made[(symbol, r.step)]
            if np.isnan(z).any():
                assert got is None
            else:
                assert got == pytest.approx(lstsq(x[whole], known["target"].to_numpy()[whole], z[0]), rel=1e-7)
            checked += 1
    assert checked == len(made) > 80


def test_refit_bounds_on_trends_ties_and_jumps(spark):
    rng = np.random.default_rng(3)
    frames = []
    for symbol, n in (("UP", 400), ("TIED", 300), ("JUMP", 300), ("SHORT", 3)):
        t = np.arange(n)
        x = {"UP": t * 1.0, "TIED": rng.integers(0, 3, n) * 1.0, "JUMP": rng.normal(0, 1, n) + 1e4 * (t > 200), "SHORT": t * 1.0}[symbol]
        frames += [(symbol, "train" if i < n // 2 else "test", int(i - n // 2 + 1 if i >= n // 2 else i + 1), float(x[i]), float(np.sin(x[i]) + rng.normal())) for i in t]
    df = spark.createDataFrame(frames, "symbol string, split string, step long, x double, target double")
    df = df.withColumns({"feature_date": F.lit(None).cast("timestamp_ntz"), "target_date": F.lit(None).cast("timestamp_ntz"), "current_close": F.col("x")})
    made = {(r.symbol, r.step): r.predicted for r in walk_forward_refit_bounds(df, ["x"], rows=64, side=5).collect()}
    table = df.toPandas()
    for symbol, part in table.groupby("symbol"):
        half = (part["split"] == "train").sum()
        for step in range(1, len(part) - half + 1):
            past, row = part.iloc[: half + step - 1], part.iloc[[half + step - 1]]
            x, z = winsor(past, row, ["x"])
            assert made[(symbol, step)] == pytest.approx(lstsq(x, past["target"].to_numpy(), z[0]), rel=1e-6, abs=1e-6)
    assert walk_forward_refit_bounds(df.where("symbol = 'none'"), ["x"]).collect() == []


def test_later_test_rows_do_not_change_earlier_forecasts(samples):
    changed = samples.withColumn("target", F.when((F.col("split") == "test") & (F.col("step") > 3), 0.0).otherwise(F.col("target")))
    a = reg.walk_forward_linear(samples, ["close"]).where("step <= 4").select("symbol", "step", F.round("predicted", 8))
    b = reg.walk_forward_linear(changed, ["close"]).where("step <= 4").select("symbol", "step", F.round("predicted", 8))
    assert a.exceptAll(b).count() == 0


def test_wide_fit_and_walk_forward(samples, table):
    flat = samples.select("symbol", "split", "step", F.col("target").alias("y"), F.array("close", "volume", "open").alias("x"))
    history, steps = flat.where("split <> 'test'"), flat.where("split = 'test'")
    model = {r.symbol: np.array(r.weights) for r in reg.fit_wide(history, ["symbol"]).collect()}
    made = {(r.symbol, r.step): r.predicted for r in reg.walk_forward_wide(history, steps, rows=4).collect()}
    cols = ["close", "volume", "open"]
    for symbol, part in table.groupby("symbol"):
        base = part[part["split"] != "test"]
        for r in part[part["split"] == "test"].itertuples():
            row = np.array([r.close, r.volume, r.open])
            want = lstsq(base[cols].to_numpy(), base["target"].to_numpy(), row)
            assert model[symbol] @ np.concatenate([[1.0], row]) == pytest.approx(want, rel=1e-6)
            known = part[part["pos"] < r.pos]
            assert made[(symbol, r.step)] == pytest.approx(lstsq(known[cols].to_numpy(), known["target"].to_numpy(), row), rel=1e-6)


def test_selection_log(samples):
    made = reg.selection_log(samples, ["close"]).collect()
    assert {r.symbol for r in made} == set(SIZES) and all(r.rmse > 0 and r.phase == "selection" for r in made)


@pytest.mark.parametrize("level", [1e3, 1e5, 1e7])
def test_walk_forward_keeps_its_digits_at_any_level(spark, level):
    rng = np.random.default_rng(4)
    n = 300
    x = np.cumsum(rng.normal(0, 1, n))
    y = 2 * x + rng.normal(0, 0.1, n)
    rows = [("A", "train" if i < 200 else "test", i - 199 if i >= 200 else i + 1, float(level + x[i]), float(level + y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, split string, step long, x double, target double")
    df = df.withColumns({"feature_date": F.lit(None).cast("timestamp_ntz"), "target_date": F.lit(None).cast("timestamp_ntz"), "current_close": F.col("x")})
    made = {r.step: r.predicted for r in reg.walk_forward_linear(df, ["x"], limits=None).collect()}
    for step in (1, 50, 100):
        past = slice(0, 199 + step)
        slope, flat = np.polyfit(x[past], y[past], 1)
        assert made[step] - level == pytest.approx(flat + slope * x[199 + step], abs=1e-6 * max(1.0, level / 1e5))
