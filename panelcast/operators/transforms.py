"""Statistics fitted on training rows of each symbol and applied to all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import clip, finite
from panelcast.operators.quantiles import group_quantiles
from panelcast.operators.splits import sliding_windows
from panelcast.sources.shared import written


def fit_bounds(
    train: DataFrame, columns: Sequence[str], limits: tuple[float, float] = (0.01, 0.99), by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Clip bounds and clipped median, wide: ``{c}__lo``, ``{c}__hi``, ``{c}__median`` per group.

    Clipping keeps the order of values, so the clipped median is the clipped pair of middle values.
    """
    clean = train.select(*by, *[finite(c).alias(c) for c in columns])
    levels = {"lo": limits[0], "hi": limits[1], "mid": 0.5}
    return group_quantiles(clean, by, columns, levels).select(
        *by,
        *[F.col(f"{c}__{k}") for c in columns for k in ("lo", "hi")],
        *[F.col(f"{c}__mid").alias(f"{c}__median") for c in columns],
    )


def clipped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clip with bounds already joined; null stays null."""
    return df.withColumns({c: clip(finite(c), F.col(f"{c}__lo"), F.col(f"{c}__hi")) for c in columns})


def filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.col(f"{column}__median"), F.lit(0.0))


def without_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[f"{c}__{k}" for c in columns for k in ("lo", "hi", "median", "mean", "std")])


def fit_statistics(
    samples: DataFrame, columns: Sequence[str], limits: tuple[float, float] = (0.01, 0.99)
) -> DataFrame:
    """Bounds, median, mean and population deviation per symbol, all from the rows of split ``train``."""
    train = samples.where("split = 'train'")
    bounds = written(fit_bounds(train, columns, limits), "bounds")
    ready = clipped(train.join(bounds, "symbol"), columns).withColumns({c: filled(c) for c in columns})
    moments = ready.groupBy("symbol").agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in columns],
    )
    return bounds.join(moments, "symbol")


def standardised(samples: DataFrame, statistics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clip, fill with the median and scale every row by the fitted statistics."""
    joined = clipped(samples.join(statistics, "symbol"), columns)
    scaled = {
        c: (filled(c) - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__std") > 0, F.col(f"{c}__std")).otherwise(1.0)
        for c in columns
    }
    return without_bounds(joined.withColumns(scaled), columns)


def fit_and_scale(
    samples: DataFrame, columns: Sequence[str], limits: tuple[float, float] = (0.01, 0.99)
) -> DataFrame:
    return standardised(samples, written(fit_statistics(samples, columns, limits), "statistics"), columns)


def scaled_branch_windows(
    samples: DataFrame, branches: Mapping[str, Sequence[str]], length: int, limits: tuple[float, float] = (0.01, 0.99)
) -> DataFrame:
    """Sliding windows with one array per branch, scaled by statistics of the training rows of its columns."""
    columns = list(dict.fromkeys(c for own in branches.values() for c in own))
    return sliding_windows(fit_and_scale(samples, columns, limits), branches, length)


def dense_rows(samples: DataFrame, columns: Sequence[str], target: str = "target") -> DataFrame:
    """Feature vector and target; nothing is filled, and rows with gaps are flagged."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    return samples.select(
        "symbol", "feature_date", "split", x.alias("x"), F.col(target).alias("y"),
        F.forall(x, lambda v: v.isNotNull()).alias("complete"),
    )
