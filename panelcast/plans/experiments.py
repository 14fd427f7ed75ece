"""Backtests of the closed-form models over a prepared panel, as one prediction table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import autoregression as ar
from panelcast.operators import volatility
from panelcast.operators.evaluate import metrics, prediction_rows, first_test_dates
from panelcast.operators.regression import linear_holdout, walk_forward_linear
from panelcast.plans.panels import WINDOW, _once, samples, split_panel
from panelcast.sources.files import union_frames
from panelcast.sources.shared import written

COMPARED = ("linear_regression", "arima", "garch_return")


def attach_forecast(tests: DataFrame, forecasted: DataFrame, column: str) -> DataFrame:
    """Supervised rows with a forecast made at (symbol, seq); null where there is none, as for a symbol without a fit."""
    return tests.join(forecasted.select("symbol", "seq", F.col(column).alias("predicted")), ["symbol", "seq"], "left")


def arima_forecasts(base: DataFrame, horizon: int, p: int = 1) -> DataFrame:
    """Frozen parameters: fitted on train and validation, one forecast per row from actuals up to it."""
    lagged = ar.lagged_panel(base, ((p, 1, 0),), horizon=horizon)
    model = written(ar.fit_orders(lagged.where("split <> 'test'"), ((p, 1, 0),)), "chosen")
    return ar.with_forecast(lagged, model, horizon).select("symbol", "seq", "linear_next", "linear_current", "linear_residual")


def signals(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """What the univariate models know at each test row, whatever the horizon; written once.

    Frozen and refitted first-order coefficients, and the expanding mean of the returns.
    """

    def build() -> DataFrame:
        base = split_panel(spark, folder, source)
        lagged = ar.lagged_panel(base, ((1, 1, 0),))
        frozen = written(ar.fit_orders(lagged.where("split <> 'test'"), ((1, 1, 0),)), "chosen")
        refitted = ar.walk_forward_fits(lagged, 1).select("symbol", "seq", F.col("phi").alias("refit_phi"))
        means = volatility.expanding_mean(base).where("split = 'test'").select("symbol", "seq", "r0", "c", F.col("phi").alias("mean_phi"))
        rows = lagged.where("split = 'test'").join(frozen.select("symbol", "phi"), "symbol")
        return written(rows.join(refitted, ["symbol", "seq"]).join(means, ["symbol", "seq"]), "signals")

    return _once(spark, (folder, source, "predictions", "signals"), build)


def _experiment(spark: SparkSession, folder: str, source: str, horizon: int) -> list[DataFrame]:
    rows = samples(spark, folder, source, horizon)
    starts = first_test_dates(rows)
    shape = {"horizon": horizon, "window": WINDOW, "feature_count": 1}

    def out(scored: DataFrame, model: str, evaluation: str, feature_set: str) -> DataFrame:
        return prediction_rows(scored, starts, model=model, evaluation=evaluation, feature_set=feature_set, **shape)

    now = [F.col("d0")] + [F.lit(0.0)] * (ar.TERMS - 1)
    known = signals(spark, folder, source).select(
        "symbol", "seq",
        ar.forecast(F.col("adjclose"), now, "phi", horizon).alias("frozen"),
        ar.forecast(F.col("adjclose"), now, "refit_phi", horizon).alias("refitted"),
        volatility.price_forecast("adjclose", "c", "mean_phi", horizon).alias("mean"),
    )
    tests = written(rows.where("split = 'test'").join(known, ["symbol", "seq"]), "scored")

    def univariate(column: str, model: str, evaluation: str, feature_set: str) -> DataFrame:
        return out(tests.withColumn("predicted", F.col(column)), model, evaluation, feature_set)

    return [
        out(linear_holdout(rows, ["close"]), "linear_regression", "holdout", "close"),
        out(walk_forward_linear(rows, ["close"], horizon, limits=None), "linear_regression", "walk_forward", "close"),
        univariate("frozen", "arima", "holdout", "adjclose"),
        univariate("refitted", "arima", "walk_forward", "adjclose"),
        univariate("mean", "garch_return", "holdout", "adjclose_returns"),
        univariate("mean", "garch_return", "walk_forward", "adjclose_returns"),
    ]


def run_cells(spark: SparkSession, root: str, cells: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The rows of all cells; a cell that an earlier run committed under ``root`` is read, not computed again.

    A cell is written whole to its own folder, over what a broken run left there, and then named in ``root/committed``.
    A run that ends at any point so resumes with the first cell not named, and gives the rows of an unbroken one.
    """
    manifest = f"{root}/committed"
    spark.createDataFrame([], "cell string").write.mode("append").parquet(manifest)
    done = {r.cell for r in spark.read.schema("cell string").parquet(manifest).where(F.col("cell").isin(*cells)).distinct().collect()}
    for name, build in cells.items():
        if name not in done:
            build().write.mode("overwrite").parquet(f"{root}/cell-{name}")
            spark.createDataFrame([(name,)], "cell string").coalesce(1).write.mode("append").parquet(manifest)
    return union_frames([spark.read.parquet(f"{root}/cell-{name}") for name in cells])


def prediction_cells(spark: SparkSession, folder: str, source: str = "lineitem", horizons: tuple[int, ...] = (1, 5)) -> dict[str, Callable[[], DataFrame]]:
    """One cell per horizon, with all its models and evaluations, which share their rows."""
    return {f"h{h}": (lambda h=h: union_frames(_experiment(spark, folder, source, h))) for h in horizons}


def predictions(spark: SparkSession, folder: str, source: str = "lineitem", horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Three models, two evaluations, every horizon; each experiment is written once."""

    def build(horizon: int) -> DataFrame:
        return written(union_frames(_experiment(spark, folder, source, horizon)), f"predictions-h{horizon}")

    parts = [_once(spark, (folder, source, "predictions", h), lambda h=h: build(h)) for h in horizons]
    return union_frames(parts)


def metric_rows(spark: SparkSession, folder: str, source: str = "lineitem", horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    return _once(
        spark,
        (folder, source, "metrics", horizons),
        lambda: written(metrics(predictions(spark, folder, source, horizons)), "metrics"),
    )
