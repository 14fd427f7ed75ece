"""Least squares for all symbols at once from sums that Spark combines; only p x p systems meet numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from panelcast.operators.ordered import block_of, running_sums
from panelcast.operators.transforms import clipped, fit_bounds, without_bounds
from panelcast.sources.shared import written

SMALLEST_EIGENVALUE = 1e-12
STEP_BLOCK = 4_096


def _solve(second: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Minimum-norm solutions of a batch of scaled normal equations."""
    scale = np.sqrt(np.einsum("bii->bi", second))
    scale[~(scale > 0)] = 1.0
    ratio = second / scale[:, :, None] / scale[:, None, :]
    inverse = np.linalg.pinv(ratio, rcond=SMALLEST_EIGENVALUE, hermitian=True)
    return np.einsum("bij,bj->bi", inverse, cross / scale) / scale


@F.pandas_udf(ArrayType(DoubleType()))
def solve_normal(second: pd.Series, cross: pd.Series) -> pd.Series:
    """Coefficients from a flattened p x p matrix and a p vector; null where an entry is missing."""
    out = pd.Series([None] * len(second), dtype=object, index=second.index)
    good = [
        i
        for i, (a, b) in enumerate(zip(second, cross, strict=True))
        if a is not None and b is not None and np.isfinite(np.asarray(a, float)).all() and np.isfinite(np.asarray(b, float)).all()
    ]
    if good:
        rhs = np.array([cross.iloc[i] for i in good], dtype=float)
        p = rhs.shape[1]
        lhs = np.array([second.iloc[i] for i in good], dtype=float).reshape(-1, p, p)
        for i, row in zip(good, _solve(lhs, rhs), strict=True):
            out.iloc[i] = row.tolist()
    return out


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _square(entry, p: int) -> Column:
    return F.array(*[entry(min(i, j), max(i, j)) for i in range(p) for j in range(p)])


def dot(values: Sequence[str | Column], weights: str) -> Column:
    """Sum of value times weight; null as soon as a value is null."""
    terms = [(F.col(v) if isinstance(v, str) else v) * F.col(weights)[i] for i, v in enumerate(values)]
    return sum(terms[1:], terms[0])


# ---- one fit per group -----------------------------------------------------------------------------


def fit_linear(df: DataFrame, columns: Sequence[str], target: str = "target", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per group: ``coefficients``, ``intercept`` and ``n`` of the regression with an intercept."""
    p = len(columns)
    usable = df.dropna(subset=[*columns, target])
    moments = usable.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(target).alias("_my"),
        F.array(*[F.avg(c) for c in columns]).alias("_mx"),
        *[F.covar_pop(columns[i], columns[j]).alias(f"_s{i}_{j}") for i, j in _pairs(p)],
        F.array(*[F.covar_pop(c, target) for c in columns]).alias("_sy"),
    )
    solved = moments.withColumn(
        "coefficients", solve_normal(_square(lambda i, j: F.col(f"_s{i}_{j}"), p), "_sy")
    )
    shift = sum((F.col("_mx")[i] * F.col("coefficients")[i] for i in range(p)), F.lit(0.0))
    return solved.select(*by, "n", "coefficients", (F.col("_my") - shift).alias("intercept"))


def predict_linear(df: DataFrame, model: DataFrame, columns: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    joined = df.join(model.select(*by, "coefficients", "intercept"), list(by))
    return joined.withColumn("predicted", F.col("intercept") + dot(columns, "coefficients")).drop("coefficients", "intercept")


def linear_holdout(
    samples: DataFrame, columns: Sequence[str], limits: tuple[float, float] = (0.01, 0.99), target: str = "target"
) -> DataFrame:
    """Test rows with ``predicted``; clip bounds come from train, the fit from train and validation."""
    keep = samples.select("symbol", "split", *dict.fromkeys([*columns, target]))
    bounds = written(fit_bounds(keep.where("split = 'train'"), columns, limits), "bounds")
    history = clipped(keep.where("split <> 'test'").join(bounds, "symbol"), columns)
    model = written(fit_linear(history, columns, target), "linear-model")
    raw = {c: f"_raw_{c}" for c in columns}
    test = samples.where("split = 'test'").withColumns({r: F.col(c) for c, r in raw.items()})
    scored = predict_linear(clipped(test.join(bounds, "symbol"), columns), model, columns)
    return without_bounds(scored.withColumns({c: F.col(r) for c, r in raw.items()}), columns).drop(*raw.values())


def selection_log(samples: DataFrame, columns: Sequence[str], limits: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Train fit scored on validation rows: one row per symbol."""
    bounds = written(fit_bounds(samples.where("split = 'train'"), columns, limits), "bounds")
    ready = clipped(samples.where("split <> 'test'").join(bounds, "symbol"), columns)
    model = written(fit_linear(ready.where("split = 'train'"), columns), "linear-model")
    scored = predict_linear(ready.where("split = 'validation'"), model, columns)
    return scored.groupBy("symbol").agg(
        F.lit("selection").alias("phase"),
        F.count("predicted").alias("n"),
        F.sqrt(F.avg(F.pow(F.col("target") - F.col("predicted"), 2))).alias("rmse"),
    )


# ---- expanding fits --------------------------------------------------------------------------------


def product_sums(columns: Sequence[str], target: str, intercept: bool) -> dict[str, Column]:
    """The sums a least-squares fit needs, as named row expressions."""
    base = [F.lit(1.0)] if intercept else []
    x = base + [F.col(c).cast("double") for c in columns]
    y = F.col(target).cast("double")
    sums = {f"g{i}_{j}": x[i] * x[j] for i, j in _pairs(len(x))}
    sums.update({f"h{i}": x[i] * y for i in range(len(x))})
    return sums


def solve_sums(df: DataFrame, p: int, out: str = "coefficients") -> DataFrame:
    """Coefficients from the running sums of :func:`product_sums` (p counts the intercept)."""
    second = _square(lambda i, j: F.col(f"g{i}_{j}"), p)
    cross = F.array(*[F.col(f"h{i}") for i in range(p)])
    names = [f"g{i}_{j}" for i, j in _pairs(p)] + [f"h{i}" for i in range(p)]
    return df.withColumn(out, solve_normal(second, cross)).drop(*names)


def expanding_fit(
    history: DataFrame,
    steps: DataFrame,
    columns: Sequence[str],
    target: str,
    *,
    delay: int,
    by: Sequence[str] = ("symbol",),
    position: str = "step",
    intercept: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Coefficients for every row of ``steps``, fitted on ``history`` and on earlier step rows.

    A step row at position k becomes history at position k + ``delay``. Base history is one
    aggregate; step rows add running sums, so the cost is linear in the rows, not in row pairs.
    With an intercept all columns are first shifted by their means over the history, so that sums of products
    keep their digits at any level of the values; the shift goes back into the intercept.
    """
    shifted = [*columns, target] if intercept else []
    usable = history.dropna(subset=[*columns, target])
    if shifted:
        centres = written(usable.groupBy(*by).agg(*[F.avg(c).alias(f"_c_{k}") for k, c in enumerate(shifted)]), "centres")

        def centred(df: DataFrame) -> DataFrame:
            moved = {c: F.col(c).cast("double") - F.coalesce(f"_c_{k}", F.lit(0.0)) for k, c in enumerate(shifted)}
            return df.select(*by, *dict.fromkeys([*([position] if position in df.columns else []), *columns, target])).join(centres, list(by), "left").withColumns(moved)

        usable, steps = centred(usable), centred(steps)
    sums = product_sums(columns, target, intercept)
    names = list(sums)
    base = written(
        usable.groupBy(*by).agg(*[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()]), "base-sums"
    )
    values = {n: F.when(F.col(target).isNotNull(), c) for n, c in sums.items()}
    known = steps.dropna(subset=[*columns, target]).select(
        *by, (F.col(position) + delay).alias("_at"), F.lit(0).alias("_kind"),
        *[c.alias(f"_x_{n}") for n, c in values.items()], F.lit(None).cast("long").alias(position),
    )
    asked = steps.select(
        *by, F.col(position).alias("_at"), F.lit(1).alias("_kind"),
        *[F.lit(0.0).alias(f"_x_{n}") for n in names], F.col(position),
    )
    summed = running_sums(
        known.unionByName(asked), by, {n: F.col(f"_x_{n}") for n in names}, position="_at", tie="_kind", rows=rows
    ).where("_kind = 1")
    joined = summed.join(base, list(by), "left").withColumns(
        {n: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0.0)) for n in names}
    )
    fitted = solve_sums(joined, len(columns) + int(intercept))
    if shifted:
        w = F.col("coefficients")
        back = sum((w[k + 1] * F.coalesce(f"_c_{k}", F.lit(0.0)) for k in range(len(columns))), F.lit(0.0))
        level = w[0] + F.coalesce(f"_c_{len(columns)}", F.lit(0.0)) - back
        fitted = fitted.join(centres, list(by), "left").withColumn(
            "coefficients", F.when(w.isNotNull(), F.concat(F.array(level), F.slice(w, 2, len(columns))))
        )
    return fitted.select(*by, position, "coefficients")


def walk_forward_linear(
    samples: DataFrame,
    columns: Sequence[str],
    horizon: int = 1,
    *,
    limits: tuple[float, float] | None = (0.01, 0.99),
    leak_safe: bool = True,
    steps: int = 0,
    target: str = "target",
    rows: int | None = None,
) -> DataFrame:
    """Expanding backtest over the test rows: fit on all rows whose target is known, predict the next.

    ``limits`` clips with bounds of the history before the first step; ``None`` does not clip.
    """
    keep = samples.select("symbol", "split", "step", "feature_date", "target_date", "current_close", *dict.fromkeys([*columns, target]))
    if limits is not None:
        bounds = written(fit_bounds(keep.where("split <> 'test'"), columns, limits), "bounds")
        keep = without_bounds(clipped(keep.join(bounds, "symbol"), columns), columns)
    history, test = keep.where("split <> 'test'"), keep.where("split = 'test'")
    if steps:
        test = test.where(F.col("step") <= steps)
    fits = expanding_fit(history, test, columns, target, delay=horizon if leak_safe else 1, rows=rows)
    scored = test.join(fits, ["symbol", "step"])
    return scored.withColumn("predicted", dot([F.lit(1.0), *columns], "coefficients")).drop("coefficients")


# ---- wide vectors ----------------------------------------------------------------------------------


def wide_sums(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Product sums of (1, x, y) for array columns: rows (by, entry, total).

    Tasks add up their own rows per key and ship one small matrix each; Spark adds the matrices.
    """
    keys = list(by)
    kinds = dict(df.dtypes)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            frames = []
            for key, matrix in held.items():
                upper = matrix[np.triu_indices(len(matrix))]
                frames.append(
                    pd.DataFrame({**dict(zip(keys, key, strict=True)), "entry": np.arange(len(upper)), "part": upper})
                )
            held.clear()
            return pd.concat(frames, ignore_index=True)

        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False):
                m = np.column_stack([np.ones(len(rows)), np.stack(rows[x].to_numpy()), rows[y].to_numpy()])
                total = m.T @ m
                held[key] = held[key] + total if key in held else total
            if len(held) >= 256:
                yield flush()
        if held:
            yield flush()

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", entry int, part double"
    parts = df.select(*keys, x, y).where(F.col(y).isNotNull()).mapInPandas(add_up, schema)
    return parts.groupBy(*keys, "entry").agg(F.sum("part").alias("total"))


def packed(sums: DataFrame, by: Sequence[str], out: str = "sums") -> DataFrame:
    """One array per key; its length depends on the vector width only."""
    listed = F.array_sort(F.collect_list(F.struct("entry", "total")))
    return sums.groupBy(*by).agg(F.transform(listed, lambda e: e["total"]).alias(out))


def _unpack(upper: np.ndarray) -> np.ndarray:
    size = int((np.sqrt(8 * len(upper) + 1) - 1) / 2)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = upper
    return full + np.triu(full, 1).T


def _fit_full(full: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Intercept and coefficients from the product sums of (1, x, y)."""
    n = full[0, 0]
    if n <= 0:
        return np.full(len(full) - 1, np.nan)
    mean = full[0, 1:] / n
    centred = full[1:, 1:] / n - np.outer(mean, mean)
    lhs = centred[:-1, :-1] + ridge * np.eye(len(centred) - 1)
    slope = _solve(lhs[None], centred[None, :-1, -1])[0]
    return np.concatenate([[mean[-1] - slope @ mean[:-1]], slope])


def fit_wide(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", ridge: float = 0.0) -> DataFrame:
    """Per key: ``weights`` = (intercept, coefficients) of y on the array column x."""

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        return sums.map(lambda s: _fit_full(_unpack(np.asarray(s, float)), ridge).tolist())

    return packed(wide_sums(df, by, x, y), by).select(*by, solve("sums").alias("weights"))


def wide_dot(x: str, weights: str) -> Column:
    slopes = F.slice(F.col(weights), 2, F.size(x))
    return F.col(weights)[0] + F.aggregate(F.zip_with(x, slopes, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)


def walk_forward_wide(
    history: DataFrame, steps: DataFrame, *, delay: int = 1, ridge: float = 0.0, rows: int | None = None
) -> DataFrame:
    """Expanding fits for array features: (symbol, step, predicted) for every row of ``steps``."""

    def solver(_: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], float]:
        last: list = [None, None]

        def solve(full: np.ndarray, x: np.ndarray) -> float:
            if last[0] != full[0, 0]:  # nothing has come in since
                last[:] = full[0, 0], _fit_full(full, ridge)
            return float(last[1] @ np.concatenate([[1.0], x]))

        return solve

    known = steps.where("y is not null").select("symbol", "x", "y", (F.col("step") + delay).alias("at"))
    return walk_blocks(history, known, steps.select("symbol", "x", F.col("step").alias("at")), solver, rows=rows).withColumnRenamed("at", "step")


def walk_blocks(
    history: DataFrame,
    known: DataFrame,
    asked: DataFrame,
    solver: Callable[[pd.DataFrame], Callable[[np.ndarray, np.ndarray], float]],
    *,
    constants: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """(symbol, at, predicted) for every row of ``asked`` (symbol, x, at).

    ``history`` (symbol, x, y) is known from the start, ``known`` (symbol, x, y, at) from ``at`` on. Positions are cut
    into blocks; a block starts from the summed products of (1, x, y) of everything before it and updates its own matrix
    row by row. ``solver`` gets the row of ``constants`` of the symbol and returns the function from matrix and asked
    vector to the forecast; with constants, a symbol without any of them or without any known row has no forecasts.
    """
    rows = rows or STEP_BLOCK
    by = ["symbol"]
    marked = known.select("symbol", "x", "y", "at", F.lit(0).alias("kind"))
    events = marked.unionByName(asked.select("symbol", "x", F.lit(None).cast("double").alias("y"), "at", F.lit(1).alias("kind")))
    events = events.withColumn("_block", block_of(F.col("at"), rows))
    base = written(wide_sums(history.select("symbol", "x", "y"), by), "base-sums")
    base = base.withColumn("_block", F.lit(-1).cast("long"))
    inside = written(wide_sums(events.where("kind = 0"), [*by, "_block"]), "block-sums")
    # Each block receives the totals of all earlier blocks: running sums over the short block list.
    # Zero entries stand for blocks that only ask and hold no history of their own.
    entries = base.select("symbol", "entry").unionByName(inside.select("symbol", "entry")).distinct()
    zeros = events.select("symbol", "_block").distinct().join(entries, "symbol")
    spread = (
        inside.unionByName(base)
        .unionByName(zeros.withColumn("total", F.lit(0.0)), allowMissingColumns=True)
        .groupBy("symbol", "_block", "entry")
        .agg(F.sum("total").alias("total"))
    )

    earlier = Window.partitionBy("symbol", "entry").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.withColumn("total", F.coalesce(F.sum("total").over(earlier), F.lit(0.0))).where("_block >= 0")
    carry = packed(carried, ["symbol", "_block"], "carry")
    if constants is not None:
        carry = carry.join(constants, "symbol")

    wanted = constants is not None

    def advance(block: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["at", "kind"])
        if block.empty or wanted and start.empty:
            return pd.DataFrame({"symbol": [], "at": [], "predicted": []})
        width = len(block["x"].iloc[0]) + 2
        full = _unpack(np.asarray(start["carry"].iloc[0], float)) if len(start) else np.zeros((width, width))
        solve, out = solver(start), []
        for x, y, at, kind in zip(block["x"], block["y"], block["at"], block["kind"], strict=True):
            row = np.asarray(x, float)
            if kind == 0:
                m = np.concatenate([[1.0], row, [y]])
                full += np.outer(m, m)
            else:
                out.append((at, solve(full, row)))
        made = pd.DataFrame(out, columns=["at", "predicted"])
        made.insert(0, "symbol", block["symbol"].iloc[0])
        return made

    return (
        events.groupBy("symbol", "_block")
        .cogroup(carry.groupBy("symbol", "_block"))
        .applyInPandas(advance, "symbol string, at long, predicted double")
    )
