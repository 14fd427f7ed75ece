"""Return forecasts with a first-order autoregressive mean, weighted by a filtered variance.

Everything at a row uses that row and earlier ones, so one pass gives the refit-at-every-step
forecasts. The variance recursion forgets: what a state leaves behind shrinks per row by the largest root
of the lag weights, so a block that starts ``warm_up`` rows early ends in the same state as the whole series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelcast.operators.autoregression import mark_selected
from panelcast.operators.evaluate import metric_columns
from panelcast.operators.ordered import block_of, over_blocks, running_sums
from panelcast.operators.regression import packed
from panelcast.sources.shared import written


@dataclass(frozen=True)
class Spec:
    """Numbers of squared-shock lags (p) and variance lags (q)."""

    p: int = 1
    q: int = 1

    @property
    def name(self) -> str:
        return f"p={self.p} q={self.q}"


# Candidate specifications and the weights tried for shocks and variances.
SPECS = (Spec(1, 1), Spec(1, 2), Spec(2, 1))
SHOCK_WEIGHTS = (0.05, 0.1, 0.2)
VARIANCE_WEIGHTS = (0.6, 0.75, 0.9)
CANDIDATES = tuple((a, b) for a in SHOCK_WEIGHTS for b in VARIANCE_WEIGHTS if a + b < 1)
FORGOTTEN = 1e-18
FILTER_BLOCK = 8_192
SMALLEST_VARIANCE = 1e-12


def warm_up(spec: Spec, weights: Sequence[tuple[float, float]] = CANDIDATES) -> int:
    """Rows after which a state has shrunk to ``FORGOTTEN`` under the slowest of the weights."""
    slowest = max(max(abs(np.roots([1.0, *[-fade / spec.q] * spec.q]))) for _, fade in weights)
    if slowest >= 1:
        raise ValueError("variance weights of 1 or more do not forget")
    return int(np.ceil(np.log(FORGOTTEN) / np.log(slowest))) + spec.p


def _line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    """Intercept and slope from (weighted) sums; a flat mean where the slope is not defined."""
    spread = n * sxx - sx * sx
    slope = F.when((spread > 1e-12 * n * sxx), F.try_divide(n * sxy - sx * sy, spread)).otherwise(0.0)
    return F.try_divide(sy - slope * sx, n), slope


def lagged_returns(panel: DataFrame, price: str = "adjclose", rows: int | None = None) -> DataFrame:
    """Percent log return of the row (r0) and of the row before (r1)."""

    def compute(frame: DataFrame, w: WindowSpec) -> DataFrame:
        level = F.ln(price)
        one, two = F.lag(level, 1).over(w), F.lag(level, 2).over(w)
        return frame.withColumns({"r0": 100 * (level - one), "r1": 100 * (one - two)})

    return over_blocks(panel, ["symbol"], compute, back=2, rows=rows)


def expanding_mean(panel: DataFrame, price: str = "adjclose", rows: int | None = None) -> DataFrame:
    """Add c and phi of r0 = c + phi * r1, by ordinary least squares on all rows so far."""
    lagged = written(lagged_returns(panel, price, rows), "returns")
    pair = F.col("r1").isNotNull()
    x, y = F.when(pair, F.col("r1")), F.when(pair, F.col("r0"))
    sums = {"_n": F.when(pair, 1.0), "_sx": x, "_sy": y, "_sxx": x * x, "_sxy": x * y}
    summed = running_sums(lagged, ["symbol"], sums, rows=rows)
    c, phi = _line(*[F.col(n) for n in sums])
    enough = F.col("_n") >= 3
    return summed.withColumns({"c": F.when(enough, c), "phi": F.when(enough, phi)}).drop(*sums)


def price_forecast(price: str, c: str, phi: str, horizon: int = 1) -> Column:
    """Price ``horizon`` rows ahead: the mean recursion gives the returns, their sum moves the price."""
    level, total = F.col("r0"), F.lit(0.0)
    for _ in range(horizon):
        level = F.col(c) + F.col(phi) * level
        total = total + level
    return F.col(price) * F.exp(total / 100)


def mean_forecast(panel: DataFrame, horizon: int = 1, price: str = "adjclose", rows: int | None = None) -> DataFrame:
    """Unweighted variant: forecast from the ordinary least-squares mean."""
    return expanding_mean(panel, price, rows).withColumn("predicted", price_forecast(price, "c", "phi", horizon))


def _shocks(means: DataFrame, rows: int | None) -> DataFrame:
    """One-row-ahead squared shocks and their running mean before the row."""

    def compute(frame: DataFrame, w: WindowSpec) -> DataFrame:
        ahead = F.lag("c", 1).over(w) + F.lag("phi", 1).over(w) * F.col("r1")
        return frame.withColumn("shock2", F.pow(F.col("r0") - ahead, 2))

    made = over_blocks(means, ["symbol"], compute, back=1, rows=rows)
    has = F.col("shock2").isNotNull()
    summed = running_sums(made, ["symbol"], {"_k": F.when(has, 1.0), "_s": F.col("shock2")}, rows=rows)
    before_n = F.col("_k") - F.when(has, 1.0).otherwise(0.0)
    before_s = F.col("_s") - F.coalesce("shock2", F.lit(0.0))
    level = F.when(before_n >= 2, F.try_divide(before_s, before_n))
    return summed.withColumn("level2", level).drop("_k", "_s")


def _responses(spec: Spec, fade: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What a unit of input (candidate, row, row) and of each past variance (candidate, row, lag) leaves at later rows."""
    weight = fade / spec.q
    unit = np.zeros((length + spec.q, len(fade), 1 + spec.q))  # column 0: an input at row 0; column j: variance j rows back
    for j in range(1, spec.q + 1):
        unit[spec.q - j, :, j] = 1.0
    for i in range(length):
        unit[spec.q + i] = weight[:, None] * unit[i : spec.q + i].sum(axis=0)
        if i == 0:
            unit[spec.q, :, 0] += 1.0
    made = unit[spec.q :]
    after = np.subtract.outer(np.arange(length), np.arange(length))
    inputs = np.where((after >= 0)[:, :, None], made[np.maximum(after, 0), :, 0], 0.0)
    return inputs.transpose(2, 0, 1), made[:, :, 1:].transpose(1, 0, 2)


def _filter(shock2: np.ndarray, level2: np.ndarray, spec: Spec, weights: Sequence[tuple[float, float]] = CANDIDATES, length: int = 64) -> np.ndarray:
    """Variance per row and candidate; rows before the first level have none.

    The recursion is affine in the past variances, so ``length`` rows are one matrix product from their inputs and the
    state before them.
    """
    shock, fade = np.array(weights).T
    out = np.full((len(shock2), len(weights)), np.nan)
    ready = np.flatnonzero(np.isfinite(level2) & np.isfinite(shock2))
    if not len(ready):
        return out
    start = ready[0]
    padded = np.concatenate([np.full(spec.p, level2[start]), shock2[start:]])
    n = len(shock2) - start
    past = sum(padded[spec.p - k : spec.p - k + n] for k in range(1, spec.p + 1)) / spec.p
    drive = np.outer(level2[start:], 1 - shock - fade) + np.outer(past, shock)
    inputs, states = _responses(spec, fade, min(length, n))
    state = np.full((len(fade), spec.q), level2[start])  # latest first
    for i in range(0, n, length):
        own = drive[i : i + length]
        size = len(own)
        h = np.einsum("cij,jc->ic", inputs[:, :size, :size], own) + np.einsum("cij,cj->ic", states[:, :size], state)
        out[start + i : start + i + size] = np.maximum(h, SMALLEST_VARIANCE)
        state = np.concatenate([h[::-1].T, state], axis=1)[:, : spec.q]
    return out


def _terms(block: pd.DataFrame, spec: Spec) -> tuple[pd.DataFrame, np.ndarray]:
    """The block's own rows that have a variance, and what each adds to the sums of each candidate (row, sum, candidate).

    The sums: loss, weights, and weighted x, y, x * x and x * y of the mean regression.
    """
    h = _filter(block["shock2"].to_numpy(float), block["level2"].to_numpy(float), spec)
    own = (block["_home"] == block["_block"]).to_numpy() & np.isfinite(h).all(axis=1)
    rows, h = block[own], h[own]
    shock2, x, y = (rows[c].to_numpy(float)[:, None] for c in ("shock2", "r1", "r0"))
    w = 1 / h
    return rows, np.stack([0.5 * (np.log(h) + shock2 / h), w, w * x, w * y, w * x * x, w * x * y], axis=1)


def shock_rows(panel: DataFrame, price: str = "adjclose", rows: int | None = None) -> DataFrame:
    """Plain mean and squared shocks of every row, written once for all specifications."""
    return written(_shocks(written(expanding_mean(panel, price, rows), "means"), rows), "shocks")


def _with_warm_up(shocks: DataFrame, spec: Spec, rows: int, weights: Sequence[tuple[float, float]] = CANDIDATES) -> DataFrame:
    """Rows by ``_block``, each block with the rows before it that its state still remembers; ``_home`` is a row's own block."""
    last = block_of(F.col("seq") + warm_up(spec, weights), rows)
    some = shocks.where("shock2 is not null").select("symbol", "seq", "r0", "r1", "shock2", "level2")
    return some.withColumn("_home", block_of(F.col("seq"), rows)).withColumn("_block", F.explode(F.sequence(F.col("_home"), last)))


def filtered_variance(shocks: DataFrame, spec: Spec = SPECS[0], weights: tuple[float, float] = (0.1, 0.75), rows: int | None = None) -> DataFrame:
    """(symbol, seq, h): variance of each row under fixed weights of shocks and variances; the rest goes to the running level."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("seq")
        h = _filter(block["shock2"].to_numpy(float), block["level2"].to_numpy(float), spec, [weights])[:, 0]
        own = (block["_home"] == block["_block"]).to_numpy() & np.isfinite(h)
        return pd.DataFrame({"symbol": block["symbol"][own], "seq": block["seq"][own], "h": h[own]})

    spread = _with_warm_up(shocks, spec, rows or FILTER_BLOCK, [weights])
    return spread.groupBy("symbol", "_block").applyInPandas(run, "symbol string, seq long, h double")


def weighted_mean(shocks: DataFrame, spec: Spec, rows: int | None = None) -> DataFrame:
    """c and phi reweighted by the likeliest variance so far; rows without one keep the plain mean.

    Blocks ship the totals of their candidates' sums only; each block then adds its own rows to the totals of the blocks
    before it and keeps one candidate per row.
    """
    rows = rows or FILTER_BLOCK
    spread = written(_with_warm_up(shocks, spec, rows), "filter-rows")
    sums = 6 * len(CANDIDATES)

    def totals(block: pd.DataFrame) -> pd.DataFrame:
        _, terms = _terms(block.sort_values("seq"), spec)
        return pd.DataFrame({"symbol": block["symbol"].iloc[0], "_block": block["_block"].iloc[0], "entry": np.arange(sums), "total": terms.sum(axis=0).ravel()})

    added = written(spread.groupBy("symbol", "_block").applyInPandas(totals, "symbol string, _block long, entry int, total double"), "filter-totals")
    earlier = Window.partitionBy("symbol", "entry").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = packed(added.withColumn("total", F.coalesce(F.sum("total").over(earlier), F.lit(0.0))), ["symbol", "_block"], "carry")

    def choose(block: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own, terms = _terms(block.sort_values("seq"), spec)
        before = np.asarray(start["carry"].iloc[0], float).reshape(6, -1)
        running = before + np.cumsum(terms, axis=0)
        best = running[:, 0].argmin(axis=1)
        n, sx, sy, sxx, sxy = running[np.arange(len(own)), 1:, best].T
        spread_ = n * sxx - sx * sx
        defined = spread_ > 1e-12 * n * sxx
        slope = np.where(defined, (n * sxy - sx * sy) / np.where(defined, spread_, 1.0), 0.0)
        return pd.DataFrame({"symbol": own["symbol"], "seq": own["seq"], "wc": (sy - slope * sx) / n, "wphi": slope})

    found = spread.groupBy("symbol", "_block").cogroup(carry.groupBy("symbol", "_block")).applyInPandas(choose, "symbol string, seq long, wc double, wphi double")
    merged = shocks.join(found, ["symbol", "seq"], "left")
    return merged.withColumns({"c": F.coalesce("wc", "c"), "phi": F.coalesce("wphi", "phi")}).drop(
        "wc", "wphi", "shock2", "level2"
    )


def forecasts(
    panel: DataFrame,
    spec: Spec = SPECS[0],
    horizon: int = 1,
    price: str = "adjclose",
    rows: int | None = None,
    filter_rows: int | None = None,
    shocks: DataFrame | None = None,
) -> DataFrame:
    """Panel rows with ``predicted``; ``shocks`` may bring the rows that do not depend on the specification."""
    shocks = shock_rows(panel, price, rows) if shocks is None else shocks
    means = weighted_mean(shocks, spec, filter_rows)
    return means.withColumn("predicted", price_forecast(price, "c", "phi", horizon))


def select_spec(
    split_panel: DataFrame, specs: Sequence[Spec] = SPECS, horizon: int = 1, price: str = "adjclose"
) -> tuple[DataFrame, DataFrame]:
    """(log rows per symbol and candidate, forecasts of the chosen one)."""
    made, shocks = None, shock_rows(split_panel, price)
    for k, spec in enumerate(specs):
        one = forecasts(split_panel, spec, horizon, price, shocks=shocks).withColumns({"ordinal": F.lit(k), "order": F.lit(spec.name), "p": F.lit(spec.p), "q": F.lit(spec.q)})
        made = one if made is None else made.unionByName(one)
    made = written(made, "volatility-forecasts")

    def compute(frame: DataFrame, w: WindowSpec) -> DataFrame:
        same = F.lead("split", horizon).over(w) == F.col("split")
        return frame.withColumns(
            {
                "target": F.when(same, F.lead(price, horizon).over(w)),
                "target_date": F.when(same, F.lead("date", horizon).over(w)),
                "current_close": F.col(price),
                "feature_date": F.col("date"),
            }
        )

    targets = over_blocks(made, ["symbol", "ordinal"], compute, ahead=horizon).where("target is not null")
    targets = written(targets, "volatility-targets")
    scored = targets.where("split = 'validation' and predicted is not null")
    log = mark_selected(scored.groupBy("symbol", "ordinal", "order", "p", "q").agg(*metric_columns()))
    first = {"ordinal": F.lit(0), "order": F.lit(specs[0].name), "p": F.lit(specs[0].p), "q": F.lit(specs[0].q)}
    fallback = (
        targets.select("symbol").distinct().join(scored.select("symbol").distinct(), "symbol", "left_anti")
        .withColumns({**first, "selected": F.lit(True), "best": F.lit(True)})
    )
    log = written(log.unionByName(fallback, allowMissingColumns=True), "spec-log")
    chosen = targets.join(log.where("best").select("symbol", "ordinal"), ["symbol", "ordinal"], "left_semi")
    return log, chosen.where("split = 'test'")
