"""Elastic-net fits by proximal gradient steps for all symbols at once, with a log row per epoch.

The gradient of a squared loss needs means and covariances only. Spark adds them up once, with map-side combination;
epochs then run on p x p matrices, so their number costs no pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.regression import predict_linear
from panelcast.operators.transforms import clipped, fit_bounds, without_bounds
from panelcast.sources.shared import written

PARTS = {"train": "split = 'train'", "validation": "split = 'validation'", "refit": "split <> 'test'"}
FITTED = "epochs int, intercept double, coefficients array<double>, selection array<struct<epoch int, train_loss double, loss double>>, refit array<double>"


@dataclass(frozen=True)
class Descent:
    """``penalty`` and ``mix`` (share of the absolute penalty) apply to coefficients in units of deviations.

    ``rate`` (at most 1) over the number of columns is the step: the largest eigenvalue of a correlation matrix is at
    most its size, so the penalised loss never rises. A selection ends after ``patience`` epochs in which the loss on
    validation rows did not fall by more than ``least``.
    """

    penalty: float = 0.0
    mix: float = 0.5
    rate: float = 1.0
    epochs: int = 200
    patience: int = 10
    least: float = 1e-4


def part_moments(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Per symbol: ``<part>`` = struct(n, means, covariances as a flat matrix) of (columns, target) in each of :data:`PARTS`."""
    names = [*columns, target]
    p = len(names)

    def moments(part: str) -> list:
        at = [F.when(F.expr(PARTS[part]), F.col(c).cast("double")) for c in names]
        pairs = [F.covar_pop(at[i], at[j]).alias(f"{part}_{i}_{j}") for i in range(p) for j in range(i, p)]
        return [F.count(at[0]).alias(f"{part}_n"), *[F.avg(a).alias(f"{part}_{i}") for i, a in enumerate(at)], *pairs]

    sums = df.dropna(subset=names).groupBy("symbol").agg(*[m for part in PARTS for m in moments(part)])
    return sums.select(
        "symbol",
        *[
            F.struct(
                F.col(f"{part}_n").alias("n"),
                F.array(*[F.col(f"{part}_{i}") for i in range(p)]).alias("means"),
                F.array(*[F.col(f"{part}_{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("covariances"),
            ).alias(part)
            for part in PARTS
        ],
    )


class Problem:
    """One symbol's loss in units of the deviations of the rows that are fitted."""

    def __init__(self, fitted: dict, scored: dict | None) -> None:
        means, self.second = self._read(fitted)
        self.means = means
        self.scale = np.sqrt(np.diag(self.second))
        self.unit = np.where(self.scale > 0, self.scale, 1.0)
        ratio = self.second / np.outer(self.unit, self.unit)
        self.square, self.cross, self.own = ratio[:-1, :-1], ratio[:-1, -1], ratio[-1, -1]
        self.scored = None
        if scored is not None and scored["n"]:
            at, second = self._read(scored)
            self.scored = (at - means) / self.unit, second / np.outer(self.unit, self.unit)

    @staticmethod
    def _read(part: dict) -> tuple[np.ndarray, np.ndarray]:
        means = np.asarray(part["means"], float)
        return means, np.asarray(part["covariances"], float).reshape(len(means), -1)

    def step(self, w: np.ndarray, how: Descent) -> np.ndarray:
        size = how.rate / len(w)
        moved = w - size * (self.square @ w - self.cross)
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - size * how.penalty * how.mix, 0.0)
        return shrunk / (1 + size * how.penalty * (1 - how.mix))

    def train_loss(self, w: np.ndarray) -> float:
        return float(self.own - 2 * w @ self.cross + w @ self.square @ w)

    def loss(self, w: np.ndarray) -> float | None:
        """Mean squared error on the scored rows, over the target's variance in the fitted ones; none without rows."""
        if self.scored is None:
            return None
        shift, second = self.scored
        miss = np.append(-w, 1.0)
        return float((miss @ shift) ** 2 + miss @ second @ miss)

    def raw(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        slopes = w * self.unit[-1] / self.unit[:-1]
        return slopes, float(self.means[-1] - self.means[:-1] @ slopes)


def descend(problem: Problem, how: Descent) -> tuple[int, list[dict]]:
    """The best epoch on the scored rows (the last one if there are none) and the log up to the stop, epoch 0 included."""
    w = np.zeros(len(problem.cross))
    first = problem.loss(w)
    best, at, log = first, 0, [{"epoch": 0, "train_loss": problem.train_loss(w), "loss": first}]
    for epoch in range(1, how.epochs + 1):
        if best is not None and epoch - 1 - at >= how.patience:
            break
        w = problem.step(w, how)
        loss = problem.loss(w)
        log.append({"epoch": epoch, "train_loss": problem.train_loss(w), "loss": loss})
        if loss is None or loss < best - how.least:
            best, at = loss, epoch
    return at, log


def fit_descent(samples: DataFrame, columns: Sequence[str], target: str = "target", how: Descent = Descent()) -> DataFrame:
    """Per symbol: epochs, intercept, coefficients, the ``selection`` log and the ``refit`` losses.

    Epochs are chosen on validation rows by a fit to train rows; as many epochs then fit both. Rows with a null value
    count nowhere; a symbol without train rows has no row; without validation rows all epochs run. A constant column
    keeps the coefficient 0.
    """

    @F.pandas_udf(FITTED)
    def solve(train: pd.DataFrame, validation: pd.DataFrame, refit: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, v, r in zip(train.to_dict("records"), validation.to_dict("records"), refit.to_dict("records"), strict=True):
            epochs, log = descend(Problem(t, v), how)
            both = Problem(r, None)
            w = np.zeros(len(columns))
            losses = [both.train_loss(w)]
            for _ in range(epochs):
                w = both.step(w, how)
                losses.append(both.train_loss(w))
            slopes, intercept = both.raw(w)
            out.append((epochs, intercept, slopes.tolist(), log, losses))
        return pd.DataFrame(out, columns=["epochs", "intercept", "coefficients", "selection", "refit"])

    ready = part_moments(samples, columns, target).where("train.n > 0")
    return ready.select("symbol", solve("train", "validation", "refit").alias("fit")).select("symbol", "fit.*")


def clipped_descent(samples: DataFrame, columns: Sequence[str], how: Descent = Descent(), limits: tuple[float, float] = (0.01, 0.99)) -> tuple[DataFrame, DataFrame]:
    """The written fits and the clipped rows they come from; bounds are those of train rows."""
    bounds = written(fit_bounds(samples.where("split = 'train'"), columns, limits), "bounds")
    ready = clipped(samples.join(bounds, "symbol"), columns)
    return written(fit_descent(ready, columns, how=how), "descent"), ready


def epoch_log(model: DataFrame, name: str) -> DataFrame:
    """(symbol, model, phase, epoch, train_loss, loss): one row per symbol, phase and epoch; ``loss`` is null in the refit."""
    chosen = model.select("symbol", F.lit("selection").alias("phase"), F.explode("selection").alias("at")).select("symbol", "phase", "at.*")
    again = model.select("symbol", F.lit("refit").alias("phase"), F.posexplode("refit").alias("epoch", "train_loss"))
    return chosen.unionByName(again.withColumn("loss", F.lit(None).cast("double"))).withColumn("model", F.lit(name))


def descent_holdout(samples: DataFrame, columns: Sequence[str], how: Descent = Descent()) -> DataFrame:
    """Test rows with ``predicted`` of the refitted coefficients."""
    model, ready = clipped_descent(samples, columns, how)
    return without_bounds(predict_linear(ready.where("split = 'test'"), model, columns), columns)
