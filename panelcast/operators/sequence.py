"""Forecasts from windows of scaled features: linear regression on the flattened window.

It stands in for recurrent networks: the windows, scaling and refit rules are the same, the learner is
a least-squares fit whose product sums Spark adds up per symbol or over all symbols.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import autoregression as ar
from panelcast.operators.regression import fit_wide, walk_forward_wide, wide_dot
from panelcast.operators.splits import merged_for_refit, sliding_windows, supervised, supervised_positions
from panelcast.operators.transforms import fit_and_scale
from panelcast.sources.shared import written

RIDGE = 1e-9
CARRIED = ("symbol", "feature_date", "target_date", "current_close", "target", "split", "step")


def flat_windows(
    samples: DataFrame, columns: Sequence[str], window: int, y: str = "target", refit: bool = True, extra: Sequence[str] = ()
) -> DataFrame:
    """Scaled windows as one flat array ``x`` with target ``y``; statistics from the refit training rows."""
    ready = merged_for_refit(samples) if refit else samples
    scaled = fit_and_scale(ready.withColumn("y", F.col(y)), columns)
    windows = sliding_windows(scaled, {"_w": columns}, window)
    return windows.select(*CARRIED, *extra, "y", F.flatten("_w").alias("x"))


def holdout(samples: DataFrame, columns: Sequence[str], window: int) -> DataFrame:
    """One fit per symbol on train and validation windows; test rows with ``predicted``."""
    flat = written(flat_windows(samples, columns, window), "windows")
    model = written(fit_wide(flat.where("split = 'train'"), ["symbol"], ridge=RIDGE), "window-model")
    return flat.where("split = 'test'").join(model, "symbol").withColumn("predicted", wide_dot("x", "weights")).drop("weights", "x")


def pooled_holdout(samples: DataFrame, columns: Sequence[str], window: int, penalty: float = 0.0, mix: float = 0.0) -> DataFrame:
    """One elastic-net fit over the windows of all symbols.

    Prices differ by orders of magnitude between symbols, so the target is the return over the horizon.
    """
    flat = written(flat_windows(samples, columns, window), "windows")
    ready = flat.select("*", array_to_vector("x").alias("features"), (F.col("target") / F.col("current_close") - 1).alias("label"))
    learner = LinearRegression(regParam=penalty, elasticNetParam=mix, solver="auto", maxIter=50)
    model = learner.fit(ready.where("split = 'train'"))
    scored = model.transform(ready.where("split = 'test'"))
    return scored.withColumn("predicted", F.col("current_close") * (1 + F.col("prediction"))).drop(
        "features", "label", "prediction", "x"
    )


def walk_forward(samples: DataFrame, columns: Sequence[str], window: int, horizon: int = 1, steps: int = 0, rows: int | None = None) -> DataFrame:
    """Expanding refits over the test windows; scaling stays as fitted before the first step.

    A linear fit with an intercept does not depend on the scaling, so only the clip bounds are frozen.
    """
    flat = written(flat_windows(samples, columns, window), "windows")
    test = flat.where("split = 'test'")
    if steps:
        test = test.where(F.col("step") <= steps)
    made = walk_forward_wide(flat.where("split = 'train'"), test, delay=horizon, ridge=RIDGE, rows=rows)
    return test.join(made, ["symbol", "step"]).drop("x")


def residual_samples(split_panel: DataFrame, forecasted: DataFrame, horizon: int = 1) -> DataFrame:
    """Supervised rows with the residual as feature and target and the linear forecast beside it.

    ``forecasted`` brings linear_residual and linear_next for (symbol, seq).
    """
    signals = forecasted.select("symbol", "seq", "linear_residual", "linear_next")
    joined = split_panel.join(signals, ["symbol", "seq"])
    made = supervised(joined, horizon, extra={"target_residual": "linear_residual"})
    return supervised_positions(made, split_panel, horizon)


def residual_hybrid(
    split_panel: DataFrame,
    columns: Sequence[str],
    window: int,
    order: tuple[int, int, int] = (1, 1, 0),
    horizon: int = 1,
) -> DataFrame:
    """Linear forecast plus a window regression on its residual; fitted on train and validation."""
    lagged = ar.lagged_panel(split_panel, (order,))
    chosen = written(ar.fit_orders(lagged.where("split <> 'test'"), (order,)), "chosen")
    forecasted = ar.with_forecast(lagged, chosen, horizon, errors=bool(order[2])).dropna(subset=["linear_residual"])
    samples = written(residual_samples(split_panel, forecasted, horizon), "residual-samples")
    names = ["linear_residual", *[c for c in columns if c != "linear_residual"]]
    flat = written(flat_windows(samples, names, window, y="target_residual", extra=["linear_next"]), "windows")
    model = written(fit_wide(flat.where("split = 'train'"), ["symbol"], ridge=RIDGE), "window-model")
    scored = flat.where("split = 'test'").join(model, "symbol")
    return scored.withColumn("predicted", F.col("linear_next") + wide_dot("x", "weights")).drop("weights", "x")
