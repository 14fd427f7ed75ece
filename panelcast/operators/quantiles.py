"""Exact linear-interpolated quantiles per group, safe for groups of any size.

Small groups use the built-in ``percentile``. That aggregate keeps every distinct value of a group in
one buffer, so beyond ``FAST_ROWS`` rows a group takes another way: a mergeable sketch proposes cut
points around each wanted rank, rows are counted per cell, and only the cells that hold a wanted rank
are ordered. The sketch steers the work but not the answer: ranks come from exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources.shared import written

FAST_ROWS = 1_000_000


def _largest_group(df: DataFrame, by: Sequence[str]) -> int:
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    levels: dict[str, float],
    fast_rows: int | None = None,
) -> DataFrame:
    """One row per group with ``{column}__{name}`` for every column and named level; nulls are skipped."""
    fast_rows = FAST_ROWS if fast_rows is None else fast_rows
    if _largest_group(df, by) <= fast_rows:
        wanted = F.array(*[F.lit(q) for q in levels.values()])
        exact = df.groupBy(*by).agg(*[F.percentile(c, wanted).alias(c) for c in columns])
        return exact.select(
            *by,
            *[
                F.col(c)[i].alias(f"{c}__{name}")
                for c in columns
                for i, name in enumerate(levels)
            ],
        )
    long = df.select(
        *by, F.explode(F.array(*[_named(c) for c in columns])).alias("_cell")
    ).select(*by, F.col("_cell.column").alias("_column"), F.col("_cell.value").alias("_value"))
    long = long.where(F.col("_value").isNotNull())
    per_column = _by_ranks(long, [*by, "_column"], levels)
    groups = df.select(*by).distinct()
    picked = per_column.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("_column") == c, F.col(name))).alias(f"{c}__{name}")
            for c in columns
            for name in levels
        ]
    )
    return groups.join(picked, list(by), "left")


def _named(column: str) -> Column:
    return F.struct(F.lit(column).alias("column"), F.col(column).cast("double").alias("value"))


def _by_ranks(long: DataFrame, by: list[str], levels: dict[str, float], slack: float = 0.0005) -> DataFrame:
    edges = sorted({min(max(q + s, 0.0), 1.0) for q in levels.values() for s in (-slack, slack)})
    cuts = long.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_value", [float(e) for e in edges], 20_000).alias("_cuts"),
    )
    cuts = written(cuts, "cuts")
    cell = F.aggregate(
        "_cuts", F.lit(0), lambda acc, cut: acc + F.when(F.col("_value") > cut, 1).otherwise(0)
    )
    celled = long.join(cuts, by).withColumn("_cell", cell).select(*by, "_n", "_cell", "_value")

    sizes = celled.groupBy(*by, "_cell").agg(F.count("*").alias("_size"), F.max("_n").alias("_n"))
    up_to = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    spans = sizes.withColumn("_end", F.sum("_size").over(up_to)).withColumn(
        "_start", F.col("_end") - F.col("_size")
    )
    place = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in levels.items()}
    ranks = F.array_distinct(
        F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place.values()]))
    )
    wanted = (
        spans.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_end"))))
        .where(F.size("_ranks") > 0)
        .select(*by, "_cell", "_start", "_ranks", "_n")
    )
    wanted = written(wanted, "ranks")
    counted = (
        celled.drop("_n").join(wanted, [*by, "_cell"])
        .groupBy(*by, "_cell", "_value")
        .agg(F.count("*").alias("_k"), *[F.first(c).alias(c) for c in ("_start", "_ranks", "_n")])
    )
    ordered = Window.partitionBy(*by, "_cell").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_to", F.col("_start") + F.sum("_k").over(ordered)).withColumn(
        "_from", F.col("_to") - F.col("_k")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_value")))

    found = placed.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        *[at(F.floor(p)).alias(f"_lo_{name}") for name, p in place.items()],
        *[at(F.ceil(p)).alias(f"_hi_{name}") for name, p in place.items()],
    )
    return found.select(
        *by,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (p - F.floor(p))
            ).alias(name)
            for name, p in place.items()
        ],
    )
