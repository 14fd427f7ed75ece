import numpy as np
import pytest

from panelcast.operators.quantiles import group_quantiles

LEVELS = {"lo": 0.01, "mid": 0.5, "hi": 0.99, "all": 1.0}


@pytest.mark.parametrize("fast_rows", [10_000, 0])
def test_both_ways_match_numpy(spark, fast_rows):
    rng = np.random.default_rng(1)
    data = {
        "hot": rng.exponential(5, 3000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]), "flat": np.full(50, 7.0), "signs": rng.normal(0, 1, 333),
    }
    rows = [(k, float(v), float(-v)) for k, vs in data.items() for v in vs] + [("hot", None, 1.0), ("void", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    made = {r["k"]: r for r in group_quantiles(df, ["k"], ["v", "w"], LEVELS, fast_rows).collect()}
    for k, vs in data.items():
        for name, q in LEVELS.items():
            assert made[k][f"v__{name}"] == pytest.approx(np.quantile(vs, q), abs=1e-9), (k, name)
    assert made["void"]["v__mid"] is None
