import pytest

from panelcast.config import Settings


def test_defaults():
    s = Settings()
    assert (s.prediction_horizon, s.prediction_horizons, s.window_sizes) == (1, (1, 5), (20, 60))
    assert (s.price_column, s.split_mode, s.evaluation_modes) == ("adjclose", "date", ("holdout", "walk_forward"))


@pytest.mark.parametrize(
    "bad",
    [
        {"train_ratio": 0.8}, {"evaluation_modes": ("other",)}, {"split_mode": "random"}, {"prediction_horizon": 0}, {"prediction_horizons": (1, 0)},
        {"prediction_cutoff": "open"}, {"backtest_window_type": "rolling"}, {"extreme_volatility_quantile": 1.0}, {"window_sizes": ()},
        {"window_sizes": (0,)}, {"winsorize_limits": (0.5,)}, {"winsorize_limits": (0.9, 0.1)}, {"walk_forward_steps": -1},
    ],
)
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
