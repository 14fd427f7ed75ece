import numpy as np
import pandas as pd
import pytest

from panelcast.operators import transforms

SCHEMA = "symbol string, split string, seq long, a double, b double, c double"
COLS = ["a", "b", "c"]


def frame():
    rng = np.random.default_rng(5)
    parts = []
    for symbol, n in (("A", 200), ("B", 15), ("C", 2)):
        a = rng.exponential(3, n)
        a[rng.random(n) < 0.2] = np.nan
        part = pd.DataFrame({"symbol": symbol, "split": np.where(np.arange(n) < 0.7 * n, "train", "test"), "seq": np.arange(n), "a": a, "b": 5.0, "c": np.nan})
        parts.append(part)
    made = pd.concat(parts, ignore_index=True)
    made.loc[[3, 4], "a"] = [np.inf, -np.inf]
    made.loc[made["split"] == "test", "c"] = 8.0
    return made


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame().itertuples(index=False)], SCHEMA)


def brute(part):
    train = part["split"] == "train"
    out = {}
    for c in COLS:
        v = part[c].replace([np.inf, -np.inf], np.nan)
        lo, hi = v[train].quantile(0.01), v[train].quantile(0.99)
        if not (np.isnan(lo) or np.isnan(hi)):
            v = v.clip(lo, hi)
        middle = v[train].median()
        v = v.fillna(0.0 if np.isnan(middle) else middle)
        std = v[train].std(ddof=0)
        out[c] = (v - v[train].mean()) / (std if std > 0 else 1.0)
    return pd.DataFrame(out)


def test_scaling_matches_brute_force(rows):
    made = transforms.fit_and_scale(rows, COLS).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)
    want = pd.concat([brute(p) for _, p in frame().groupby("symbol")], ignore_index=True)
    for c in COLS:
        assert np.allclose(made[c], want[c], atol=1e-9), c


def test_statistics_ignore_test_rows(rows, spark):
    changed = rows.selectExpr("symbol", "split", "seq", "if(split = 'test', a * 100, a) a", "b", "c")
    a = transforms.fit_statistics(rows, COLS).orderBy("symbol").collect()
    assert a == transforms.fit_statistics(changed, COLS).orderBy("symbol").collect()


def test_dense_rows_flag_gaps(rows):
    made = transforms.dense_rows(rows.withColumnRenamed("seq", "target").selectExpr("*", "timestamp_ntz'2024-01-01' as feature_date"), ["a", "b"])
    assert made.where("not complete").count() == frame()["a"].isna().sum()
