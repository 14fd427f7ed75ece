import numpy as np
import pytest
from helpers import make_panel, to_spark
from pyspark.sql import functions as F

from panelcast.operators.features import price_features, FEATURES, forward_targets, percent_log_returns
from panelcast.operators.ordered import number_rows, over_blocks, running_sums

SIZES = {"HOT": 230, "B": 40, "C": 1, "D": 12}


@pytest.fixture(scope="module")
def frame():
    made = make_panel(SIZES)
    rng = np.random.default_rng(3)
    made.loc[rng.random(len(made)) < 0.3, "volume"] = np.nan
    made.loc[20:45, "volume"] = np.nan
    made.loc[50, "volume"] = 0.0
    return made


@pytest.fixture(scope="module")
def panel(spark, frame):
    return to_spark(spark, frame).repartition(7).cache()


def test_row_numbers_match_sorted_positions(spark, panel):
    for grain in ("day", "month", "year"):
        made = number_rows(panel.drop("seq"), ["symbol"], grain=grain, out="n").join(panel.select("symbol", "date", "seq"), ["symbol", "date"])
        assert made.where("n <> seq").count() == 0 and made.count() == sum(SIZES.values())


@pytest.mark.parametrize("rows", [1, 3, 16, 1000])
def test_bounded_frames_do_not_see_block_edges(panel, rows):
    def compute(df, w):
        return df.withColumns({"a": F.lag("close", 5).over(w), "b": F.lead("close", 4).over(w), "s": F.sum("close").over(w.rowsBetween(-5, 4))})

    cut = over_blocks(panel, ["symbol"], compute, back=5, ahead=4, rows=rows)
    whole = over_blocks(panel, ["symbol"], compute, back=5, ahead=4)
    cols = ["symbol", "seq", "a", "b", F.round("s", 6)]
    assert cut.select(*cols).exceptAll(whole.select(*cols)).count() == 0
    assert cut.count() == sum(SIZES.values())


@pytest.mark.parametrize("rows", [2, 17, 1000])
def test_running_sums(panel, frame, rows):
    made = running_sums(panel, ["symbol"], {"t": F.col("close")}, rows=rows).toPandas().sort_values(["symbol", "seq"])
    want = frame.sort_values(["symbol", "seq"]).groupby("symbol")["close"].cumsum()
    assert np.allclose(made["t"], want)


@pytest.mark.parametrize("rows", [4, 1000])
def test_features_match_pandas(panel, frame, rows):
    made = price_features(panel, rows=rows).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)
    f = frame.sort_values(["symbol", "seq"]).reset_index(drop=True)
    price = f.groupby("symbol")["adjclose"]
    r1 = price.pct_change()
    filled = f.groupby("symbol")["volume"].ffill()
    volume = filled / filled.groupby(f["symbol"]).shift(1) - 1
    grouped = r1.groupby(f["symbol"])
    want = {
        "feature_price_return_1": r1,
        "feature_price_return_5": price.pct_change(5),
        "feature_log_return_1": np.log(r1 + 1),
        "feature_volume_return_1": volume.replace([np.inf, -np.inf], np.nan),
        "feature_intraday_return": (f.close - f.open) / f.open,
        "feature_high_low_spread": (f.high - f.low) / f.adjclose,
        "feature_rolling_volatility_5": grouped.transform(lambda s: s.rolling(5).std()),
        "feature_rolling_volatility_10": grouped.transform(lambda s: s.rolling(10).std()),
        "feature_rolling_mean_return_5": grouped.transform(lambda s: s.rolling(5).mean()),
    }
    assert set(want) == set(FEATURES)
    for name, values in want.items():
        assert np.allclose(made[name], values.fillna(0.0), atol=1e-9), name


def test_existing_feature_is_kept(panel):
    made = price_features(panel.withColumn("feature_price_return_1", F.lit(9.0)))
    assert made.agg(F.min("feature_price_return_1"), F.max("feature_price_return_1")).first()[:] == (9.0, 9.0)


def test_targets_and_log_returns(panel, frame):
    made = forward_targets(panel, 3, rows=5)
    assert made.where("target_date is null").count() == sum(min(3, n) for n in SIZES.values())
    assert percent_log_returns(panel, rows=5).count() == sum(n - 1 for n in SIZES.values())


def test_later_rows_do_not_change_earlier_features(panel):
    changed = panel.withColumn("adjclose", F.when(F.col("seq") > 30, F.col("adjclose") * 3).otherwise(F.col("adjclose")))
    cols = ["symbol", "seq", *FEATURES]
    a = price_features(panel).where("seq <= 30").select(*cols)
    assert a.exceptAll(price_features(changed).where("seq <= 30").select(*cols)).count() == 0
