"""Autoregressive price forecasts by conditional least squares on price differences, no constant.

Orders are (p, 1, q). A moving-average part (q > 0) regresses on lagged residuals of a long
autoregression, so every regressor is a combination of lagged differences of the same row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelcast.operators.evaluate import metric_columns
from panelcast.operators.ordered import over_blocks
from panelcast.operators.regression import dot, expanding_fit, solve_normal
from panelcast.sources.shared import written

# Candidate orders, tried in this sequence, and the default order.
ORDERS = ((1, 1, 0), (2, 1, 0), (3, 1, 0), (5, 1, 0), (2, 1, 2), (3, 1, 3))
DEFAULT_ORDER = (5, 1, 0)
AR_TERMS, MA_TERMS, LONG_TERMS = 5, 3, 8
TERMS = AR_TERMS + MA_TERMS
DEEPEST = LONG_TERMS + MA_TERMS + 1


def order_name(order: tuple[int, int, int]) -> str:
    return f"({order[0]}, {order[1]}, {order[2]})"


def differenced(
    panel: DataFrame, price: str = "adjclose", deepest: int = DEEPEST, rows: int | None = None, horizon: int = 0
) -> DataFrame:
    """Add d0, d1, ...: the price change of the row and of the rows before it.

    With a ``horizon`` the same exchange also adds ``target``, the price that many rows ahead inside
    the same split.
    """

    def compute(frame: DataFrame, w: WindowSpec) -> DataFrame:
        lagged = {f"_p{i}": F.lag(price, i).over(w) for i in range(1, deepest + 2)}
        stepped = frame.withColumns(lagged).withColumn("_p0", F.col(price).cast("double"))
        made = {f"d{i}": F.col(f"_p{i}") - F.col(f"_p{i + 1}") for i in range(deepest + 1)}
        if horizon:
            same = F.lead("split", horizon).over(w) == F.col("split")
            made["target"] = F.when(same, F.lead(price, horizon).over(w))
        return stepped.withColumns(made).drop(*[f"_p{i}" for i in range(deepest + 2)])

    return over_blocks(panel, ["symbol"], compute, back=deepest + 1, ahead=horizon, rows=rows)


def _sums(x: Sequence[Column], y: Column) -> dict[str, Column]:
    n = len(x)
    made = {f"g{i}_{j}": F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)}
    made.update({f"h{i}": F.sum(x[i] * y) for i in range(n)})
    return made


def _solved(sums: DataFrame, keys: Sequence[str], n: int, out: str) -> DataFrame:
    second = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)])
    return sums.select(*keys, solve_normal(second, F.array(*[F.col(f"h{i}") for i in range(n)])).alias(out))


def fit_long(history: DataFrame) -> DataFrame:
    """First stage of the moving-average orders: one long autoregression per symbol."""
    x = [F.col(f"d{i}") for i in range(1, LONG_TERMS + 1)]
    usable = history.dropna(subset=[f"d{i}" for i in range(LONG_TERMS + 1)])
    sums = usable.groupBy("symbol").agg(*[c.alias(n) for n, c in _sums(x, F.col("d0")).items()])
    return _solved(sums, ["symbol"], LONG_TERMS, "long_weights")


def with_residuals(lagged: DataFrame, long_model: DataFrame) -> DataFrame:
    """Add e0, e1, ...: residuals of the long autoregression at the row and before it."""
    joined = lagged.join(long_model, "symbol", "left")
    made = {
        f"e{j}": F.col(f"d{j}") - dot([f"d{j + i}" for i in range(1, LONG_TERMS + 1)], "long_weights")
        for j in range(MA_TERMS + 1)
    }
    return joined.withColumns(made).drop("long_weights")


def _regressors(back: int, p: Column, q: Column, has_errors: bool) -> list[Column]:
    """Terms as of ``back`` rows before the row (0: known now, 1: known one row ago), masked by order."""
    ar = [F.when(p >= i + 1, F.col(f"d{i + back}")).otherwise(0.0) for i in range(AR_TERMS)]
    ma = [
        F.when(q >= j + 1, F.col(f"e{j + back}")).otherwise(0.0) if has_errors else F.lit(0.0)
        for j in range(MA_TERMS)
    ]
    return ar + ma


def _orders_column(orders: Sequence[tuple[int, int, int]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(k).alias("ordinal"), F.lit(order_name(o)).alias("order"), F.lit(o[0]).alias("p"), F.lit(o[2]).alias("q"))
            for k, o in enumerate(orders)
        ]
    )


def fit_orders(history: DataFrame, orders: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Rows (symbol, ordinal, order, p, q, phi) for all orders in one aggregation.

    ``phi`` has eight places, zero where the order has no such term.
    """
    errors = any(o[2] for o in orders)
    rows = history.withColumn("_o", F.explode(_orders_column(orders))).select("*", "_o.*").drop("_o")
    p, q = F.col("p"), F.col("q")
    x = _regressors(1, p, q, errors)
    complete = F.col("d0").isNotNull()
    for term in x:
        complete = complete & term.isNotNull()
    keys = ["symbol", "ordinal", "order", "p", "q"]
    sums = rows.where(complete).groupBy(*keys).agg(*[c.alias(n) for n, c in _sums(x, F.col("d0")).items()])
    return _solved(sums, keys, TERMS, "phi")


def forecast(p_now: Column, terms: Sequence[Column], phi: str, horizon: int) -> Column:
    """Price ``horizon`` rows ahead from what is known now; later steps feed on earlier forecasts."""
    ar, ma = list(terms[:AR_TERMS]), list(terms[AR_TERMS:])
    weights = [F.col(phi)[i] for i in range(TERMS)]
    level = p_now
    for _ in range(horizon):
        step = sum((w * F.coalesce(v, F.lit(0.0)) for w, v in zip(weights, ar + ma, strict=True)), F.lit(0.0))
        level = level + step
        ar, ma = [step, *ar[:-1]], [F.lit(0.0), *ma[:-1]]
    return level


def with_forecast(
    lagged: DataFrame, model: DataFrame, horizon: int = 1, price: str = "adjclose", errors: bool = False
) -> DataFrame:
    """Add ``linear_next`` (forecast from the row) and ``linear_current`` (forecast of the row)."""
    joined = lagged.join(model.select("symbol", "phi"), "symbol")
    every = (F.lit(AR_TERMS), F.lit(MA_TERMS if errors else 0))
    now = _regressors(0, *every, errors)
    before = _regressors(1, *every, errors)
    return joined.withColumns(
        {
            "linear_next": forecast(F.col(price), now, "phi", horizon),
            "linear_current": forecast(F.col(price) - F.col("d0"), before, "phi", 1),
        }
    ).withColumn("linear_residual", F.col(price) - F.col("linear_current"))


def score_orders(
    lagged: DataFrame, models: DataFrame, split: str, horizon: int = 1, price: str = "adjclose"
) -> DataFrame:
    """Metrics of every candidate on one split of a lagged panel that carries ``target``."""
    errors = "e0" in lagged.columns
    ready = lagged.where((F.col("split") == split) & F.col("target").isNotNull())
    joined = ready.join(models, "symbol")
    now = _regressors(0, F.col("p"), F.col("q"), errors)
    scored = joined.withColumns({"current_close": F.col(price), "predicted": forecast(F.col(price), now, "phi", horizon)})
    return scored.groupBy("symbol", "ordinal", "order", "p", "q").agg(*metric_columns())


def mark_selected(scores: DataFrame) -> DataFrame:
    """``selected`` marks running minima in grid order, as the log shows them; ``best`` the final choice.

    A candidate without an error is never selected and counts as infinitely bad for those after it.
    """
    best = scores.groupBy("symbol").agg(F.min(F.struct(F.coalesce("rmse", F.lit(float("inf"))), "ordinal")).alias("_best"))
    earlier = scores.select("symbol", F.col("ordinal").alias("_o"), F.col("rmse").alias("_r"))
    grid = earlier.groupBy("symbol").agg(F.collect_list(F.struct("_o", "_r")).alias("_all"))
    joined = scores.join(grid, "symbol").join(best, "symbol")
    return joined.withColumns(
        {
            "selected": F.coalesce(
                F.forall("_all", lambda c: (c["_o"] >= F.col("ordinal")) | (F.coalesce(c["_r"], F.lit(float("inf"))) > F.col("rmse"))) & F.col("rmse").isNotNull(),
                F.lit(False),
            ),
            "best": F.col("ordinal") == F.col("_best.ordinal"),
        }
    ).drop("_all", "_best")


def lagged_panel(
    split_panel: DataFrame, orders: Sequence[tuple[int, int, int]] = ORDERS, price: str = "adjclose", horizon: int = 1
) -> DataFrame:
    """Differences, targets and, where an order needs them, residuals of a long autoregression of train."""
    errors = any(o[2] for o in orders)
    base = split_panel.select("symbol", "date", "seq", "split", price)
    lagged = written(differenced(base, price, DEEPEST if errors else AR_TERMS, horizon=horizon), "differences")
    if errors:
        long_model = written(fit_long(lagged.where("split = 'train'")), "long-model")
        lagged = with_residuals(lagged, long_model)
    return lagged


def select_order(
    lagged: DataFrame,
    orders: Sequence[tuple[int, int, int]] = ORDERS,
    default: tuple[int, int, int] = DEFAULT_ORDER,
    horizon: int = 1,
    price: str = "adjclose",
) -> DataFrame:
    """One log row per symbol and candidate; symbols with too short a validation take the default."""
    if default not in orders:
        orders = (*orders, default)
    models = written(fit_orders(lagged.where("split = 'train'"), orders), "order-models")
    scores = mark_selected(score_orders(lagged, models, "validation", horizon, price))
    fallback = (
        lagged.select("symbol").distinct().join(scores.select("symbol"), "symbol", "left_anti")
        .withColumns(
            {
                "ordinal": F.lit(orders.index(default)), "order": F.lit(order_name(default)), "p": F.lit(default[0]),
                "q": F.lit(default[2]), "selected": F.lit(True), "best": F.lit(True),
            }
        )
    )
    return scores.unionByName(fallback, allowMissingColumns=True)


def holdout(
    split_panel: DataFrame,
    orders: Sequence[tuple[int, int, int]] = ORDERS,
    horizon: int = 1,
    price: str = "adjclose",
) -> tuple[DataFrame, DataFrame]:
    """(test forecasts, selection log): order by validation error, refit on train and validation."""
    lagged = lagged_panel(split_panel, orders, price, horizon)
    errors = any(o[2] for o in orders)
    log = written(select_order(lagged, orders, horizon=horizon, price=price), "order-log")
    candidates = orders if DEFAULT_ORDER in orders else (*orders, DEFAULT_ORDER)
    refit = fit_orders(lagged.where("split <> 'test'"), candidates)
    chosen = written(refit.join(log.where("best").select("symbol", "ordinal"), ["symbol", "ordinal"], "left_semi"), "chosen")
    return with_forecast(lagged, chosen, horizon, price, errors), log


def walk_forward_fits(lagged: DataFrame, p: int, rows: int | None = None) -> DataFrame:
    """Test rows of a lagged panel with ``phi`` fitted on all changes up to and including the row."""
    usable = lagged.where("d0 is not null")
    test = usable.where("split = 'test'")
    fits = expanding_fit(
        usable.where("split <> 'test'"), test, [f"d{i}" for i in range(1, p + 1)], "d0",
        delay=0, position="seq", intercept=False, rows=rows,
    )
    padded = F.concat("coefficients", F.array_repeat(F.lit(0.0), TERMS - p))
    return test.join(fits, ["symbol", "seq"]).withColumn("phi", padded).drop("coefficients")


def walk_forward(
    split_panel: DataFrame, p: int, horizon: int = 1, price: str = "adjclose", rows: int | None = None
) -> DataFrame:
    """Test rows with a forecast refitted on all prices up to and including the row."""
    lagged = written(differenced(split_panel.select("symbol", "date", "seq", "split", price), price, p), "differences")
    now = [F.col(f"d{i}") if i < p else F.lit(0.0) for i in range(AR_TERMS)] + [F.lit(0.0)] * MA_TERMS
    return walk_forward_fits(lagged, p, rows).withColumn("linear_next", forecast(F.col(price), now, "phi", horizon))
