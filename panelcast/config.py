"""Experiment settings with the checks that every run relies on."""

from __future__ import annotations

from dataclasses import dataclass, field

# The models of a full run.
MODELS = (
    "linear_regression", "linear_regression_scaled", "arima", "garch_return", "lstm", "gru", "transformer",
    "arima_residual_lstm",
)
EVALUATIONS = ("holdout", "walk_forward")


@dataclass(frozen=True)
class Settings:
    # The defaults of a run.
    stock_symbols: tuple[str, ...] = ()
    feature_columns: tuple[str, ...] = ()
    feature_set: str = "auto"
    technical_indicators: tuple[str, ...] = ()
    target_column: str = "target_next_adjclose"
    price_column: str = "adjclose"
    prediction_horizon: int = 1
    prediction_horizons: tuple[int, ...] = (1, 5)
    prediction_cutoff: str = "close"
    window_size: int = 20
    window_sizes: tuple[int, ...] = (20, 60)
    train_ratio: float = 0.7
    val_ratio: float = 0.15
    test_ratio: float = 0.15
    split_mode: str = "date"
    evaluation_modes: tuple[str, ...] = EVALUATIONS
    walk_forward_steps: int = 0
    walk_forward_models: tuple[str, ...] = MODELS
    selected_models: tuple[str, ...] = MODELS
    backtest_window_type: str = "expanding"
    tune_order: bool = True
    extreme_volatility_quantile: float = 0.95
    winsorize_limits: tuple[float, float] = field(default=(0.01, 0.99))

    def __post_init__(self) -> None:
        total = round(self.train_ratio + self.val_ratio + self.test_ratio, 10)
        low, high = self.winsorize_limits if len(self.winsorize_limits) == 2 else (1.0, 0.0)
        rules = {
            "split ratios must add up to 1": total == 1.0,
            "evaluation_modes may hold holdout and walk_forward only": set(self.evaluation_modes) <= set(EVALUATIONS),
            "split_mode must be date or ratio": self.split_mode in ("date", "ratio"),
            "horizons must be at least 1": min((self.prediction_horizon, *self.prediction_horizons)) >= 1,
            "prediction_cutoff must be close": self.prediction_cutoff == "close",
            "backtest_window_type must be expanding": self.backtest_window_type == "expanding",
            "extreme_volatility_quantile must lie between 0 and 1": 0.0 < self.extreme_volatility_quantile < 1.0,
            "window_sizes must be positive": bool(self.window_sizes) and min(self.window_sizes) >= 1,
            "winsorize_limits must be two rising shares": 0.0 <= low < high <= 1.0,
            "walk_forward_steps must not be negative": self.walk_forward_steps >= 0,
        }
        broken = [text for text, holds in rules.items() if not holds]
        if broken:
            raise ValueError("; ".join(broken))
