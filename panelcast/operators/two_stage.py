"""Walk-forward forecasts in stages, each refitted on what the stage before it makes of the whole history.

Innovations of a long autoregression, forecasts of an order (p, 1, q) and its residuals are linear in the price changes
of a row and of those before it. So one expanding matrix of products of such changes holds the moments of every later
stage: a stage is a matrix T of coefficients that depend on the step, and its moments are T M T'. Residuals of all rows
move with each step's coefficients, though no row is touched again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators import autoregression as ar
from panelcast.operators.ordered import over_blocks
from panelcast.operators.regression import _fit_full, _solve, walk_blocks
from panelcast.operators.splits import merged_for_refit
from panelcast.operators.transforms import fit_and_scale
from panelcast.sources.shared import written


def shifted(vector: np.ndarray, by: int, size: int) -> np.ndarray:
    """``vector`` moved ``by`` places into a row of ``size``."""
    out = np.zeros(size)
    out[by : by + len(vector)] = vector
    return out


class Stages:
    """The first stages of one symbol: coefficients of an order (p, 1, q) at any step.

    ``early`` are the first rows of the symbol, those that lack some of the ``depth`` changes of the matrix (NaN); each
    stage takes those that have the changes it needs.
    """

    def __init__(self, p: int, q: int, long_terms: int, depth: int, early: np.ndarray):
        self.p, self.q, self.long, self.depth = p, q, long_terms, depth
        self.needed = long_terms + q if q else p
        self.early = early.reshape(-1, depth + 1)

    def _moments(self, lags: np.ndarray, n: int) -> np.ndarray:
        """Product sums of the first ``n`` changes and the next one over all rows that have them."""
        own = self.early[~np.isnan(self.early[:, [*range(n), -1]]).any(axis=1)][:, [*range(n), -1]]
        pick = [*range(n), self.depth]
        return lags[np.ix_(pick, pick)] + own.T @ own

    def _fitted(self, rows: np.ndarray, moments: np.ndarray) -> np.ndarray:
        """Coefficients of the next change on ``rows``, linear forms of the changes; no constant."""
        return _solve((rows @ moments[:-1, :-1] @ rows.T)[None], (rows @ moments[:-1, -1])[None])[0]

    def forms(self, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, forms): the regressors as linear forms of the changes, and their weights at this step."""
        n = self.needed
        rows = [shifted(np.ones(1), i, n) for i in range(self.p)]
        if self.q:
            b = self._fitted(np.eye(self.long), self._moments(lags, self.long))
            rows += [shifted(np.concatenate([[1.0], -b]), j, n + 1)[:n] for j in range(self.q)]
        forms = np.array(rows)
        return self._fitted(forms, self._moments(lags, n)), forms

    def forecast(self, weights: np.ndarray, forms: np.ndarray, now: np.ndarray, horizon: int) -> float:
        """Sum of the next ``horizon`` changes; later ones feed on earlier forecasts, with no further innovations."""
        values, total = forms @ now[: self.needed], 0.0
        recent, errors = values[: self.p].tolist(), values[self.p :].tolist()
        for _ in range(horizon):
            step = float(weights @ np.array([*recent, *errors]))
            total += step
            recent, errors = [step, *recent][: self.p], [0.0, *errors][: self.q]
        return total


def changes_rows(split_panel: DataFrame, depth: int, price: str, rows: int | None = None) -> DataFrame:
    """Rows with ``x``, their change and the ``depth`` - 1 before it (null where there is none), and ``y``, the next one."""

    def compute(frame: DataFrame, w: Window) -> DataFrame:
        level = lambda i: F.lag(F.col(price).cast("double"), i).over(w) if i >= 0 else F.lead(F.col(price).cast("double")).over(w)
        lagged = frame.withColumns({f"_p{i + 1}": level(i) for i in range(-1, depth + 1)})
        x = F.array(*[F.col(f"_p{i + 1}") - F.col(f"_p{i + 2}") for i in range(depth)])
        ahead = F.lead("split").over(w)
        return lagged.withColumns({"x": x, "y": F.col("_p0") - F.col("_p1"), "next_split": ahead}).drop(*[f"_p{i}" for i in range(depth + 2)])

    base = split_panel.select("symbol", "date", "seq", "split", price)
    return over_blocks(base, ["symbol"], compute, back=depth, ahead=1, rows=rows)


def _early(rows: DataFrame, depth: int) -> DataFrame:
    """Per symbol: its first rows, at most ``depth`` of them, as one flat array of changes and the next change.

    Only rows known before the first test row count.
    """
    some = rows.where(F.col("y").isNotNull() & (F.col("seq") <= depth) & (F.col("next_split") != "test")).where(F.exists("x", lambda v: v.isNull()))
    flat = F.transform(F.concat("x", F.array("y")), lambda v: F.coalesce(v, F.lit(float("nan"))))
    listed = F.array_sort(F.collect_list(F.struct("seq", flat.alias("v"))))
    return some.groupBy("symbol").agg(F.flatten(F.transform(listed, lambda e: e["v"])).alias("early"))


def _constants(rows: DataFrame, orders: DataFrame, depth: int) -> DataFrame:
    """(symbol, p, q, early)."""
    return written(orders.select("symbol", "p", "q").join(_early(rows, depth), "symbol", "left"), "stage-constants")


def _stages(start: pd.DataFrame, long_terms: int, depth: int) -> Stages:
    early = start["early"].iloc[0]
    return Stages(int(start["p"].iloc[0]), int(start["q"].iloc[0]), long_terms, depth, np.array([] if early is None else early, float))


def fixed_order(split_panel: DataFrame, order: tuple[int, int, int]) -> DataFrame:
    """The same order for every symbol: (symbol, p, q)."""
    return split_panel.select("symbol").distinct().select("symbol", F.lit(order[0]).alias("p"), F.lit(order[2]).alias("q"))


def selected_orders(split_panel: DataFrame, orders: Sequence[tuple[int, int, int]] = ar.ORDERS, price: str = "adjclose") -> DataFrame:
    """(symbol, p, q) with the least validation error of a fit on train."""
    log = ar.select_order(ar.lagged_panel(split_panel, orders, price), orders, price=price)
    return written(log.where("best").select("symbol", "p", "q"), "selected-orders")


def walk_forward_orders(
    split_panel: DataFrame, orders: DataFrame, horizon: int = 1, *, price: str = "adjclose", long_terms: int = ar.LONG_TERMS, deepest: int | None = None, rows: int | None = None
) -> DataFrame:
    """Test rows (symbol, seq, linear_next): both stages of the order in ``orders`` (symbol, p, q) refitted on all prices
    up to and including the row. ``deepest`` bounds p, and ``long_terms`` + q, of all orders.
    """
    depth = deepest or max(ar.AR_TERMS, long_terms + ar.MA_TERMS)
    made = written(changes_rows(split_panel, depth, price, rows), "changes")
    whole = made.where(F.forall("x", lambda v: v.isNotNull()))

    def solver(start: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], float]:
        stages = _stages(start, long_terms, depth)

        def solve(full: np.ndarray, x: np.ndarray) -> float:
            weights, forms = stages.forms(full[1:, 1:])
            return stages.forecast(weights, forms, x, horizon)

        return solve

    learnt = whole.where("y is not null")
    known = learnt.where("next_split = 'test'").select("symbol", "x", "y", (F.col("seq") + 1).alias("at"))
    asked = whole.where("split = 'test'").select("symbol", "x", F.col("seq").alias("at"))
    found = walk_blocks(learnt.where("next_split <> 'test'"), known, asked, solver, constants=_constants(made, orders, depth), rows=rows)
    tests = split_panel.where("split = 'test'").select("symbol", F.col("seq").alias("at"), F.col(price).alias("_price"))
    return found.join(tests, ["symbol", "at"]).select("symbol", F.col("at").alias("seq"), (F.col("_price") + F.col("predicted")).alias("linear_next"))


def walk_forward_hybrid(
    split_panel: DataFrame,
    columns: Sequence[str],
    window: int,
    orders: DataFrame,
    *,
    price: str = "adjclose",
    long_terms: int = ar.LONG_TERMS,
    deepest: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Test rows (symbol, seq, predicted): next price by the order's forecast plus a window regression on its residuals.

    At each step the first stages are refitted on all prices seen, the residuals of all rows are those of the refitted
    order, and the window regression (the last ``window`` residuals and values of ``columns``) is refitted on them.
    ``columns`` are clipped and scaled by statistics of the rows before the first test row; residuals are taken as they
    are, since a linear fit with an intercept does not depend on their scale.
    """
    first = deepest or max(ar.AR_TERMS, long_terms + ar.MA_TERMS)
    depth = first + window
    made = written(changes_rows(split_panel, depth, price, rows), "changes")
    constants = _constants(made, orders, depth)
    wide = len(columns) * window
    if columns:
        scaled = fit_and_scale(merged_for_refit(split_panel), columns)

        def compute(frame: DataFrame, w: Window) -> DataFrame:
            trailing = w.rowsBetween(-(window - 1), 0)
            return frame.withColumn("f", F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(trailing)))

        featured = over_blocks(scaled.select("symbol", "seq", *columns), ["symbol"], compute, back=window - 1, rows=rows).where(F.size("f") == wide)
        joined = made.join(featured.select("symbol", "seq", "f"), ["symbol", "seq"]).withColumn("x", F.concat("x", "f")).drop("f")
    else:
        joined = made
    whole = written(joined.where(F.forall("x", lambda v: v.isNotNull())), "window-rows")

    def solver(start: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], float]:
        stages = _stages(start, long_terms, depth)
        size = depth + wide + 2
        pick = [*range(1, depth + 1), size - 1]

        def solve(full: np.ndarray, x: np.ndarray) -> float:
            weights, forms = stages.forms(full[np.ix_(pick, pick)])
            ahead = weights @ forms
            residual = np.concatenate([[1.0], -ahead])
            turn = np.zeros((window + wide + 2, size))
            turn[0, 0] = turn[-1, -1] = 1.0
            for j in range(window):
                turn[1 + j, 1 + j : 1 + j + len(residual)] = residual
            turn[1 + window : -1, 1 + depth : -1] = np.eye(wide)
            turn[-1, 1 : 1 + len(ahead)] = -ahead
            fitted = _fit_full(turn @ full @ turn.T)
            row = turn[:-1] @ np.concatenate([[1.0], x, [0.0]])
            return stages.forecast(weights, forms, x, 1) + float(fitted @ row)

        return solve

    learnt = whole.where("y is not null")
    known = learnt.where("next_split = 'test'").select("symbol", "x", "y", (F.col("seq") + 1).alias("at"))
    asked = whole.where("split = 'test'").select("symbol", "x", F.col("seq").alias("at"))
    found = walk_blocks(learnt.where("next_split <> 'test'"), known, asked, solver, constants=constants, rows=rows)
    tests = split_panel.where("split = 'test'").select("symbol", F.col("seq").alias("at"), F.col(price).alias("_price"))
    return found.join(tests, ["symbol", "at"]).select("symbol", F.col("at").alias("seq"), (F.col("_price") + F.col("predicted")).alias("predicted"))
