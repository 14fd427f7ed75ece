"""Ordered computations per key that never put a whole key into one task.

Rows of a key are numbered by adding the counts of earlier calendar buckets to a local row number.
The numbers cut every key into blocks of equal length, and windows run per (key, block):

* bounded frames (lag, lead, rolling) copy the few rows next to a block edge into the neighbour block;
* unbounded frames (running sums, last value) add a carry taken from the totals of earlier blocks.

A key with a third of all rows therefore becomes many blocks of ``BLOCK_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


def number_rows(
    df: DataFrame, by: Sequence[str], order: str = "date", grain: str = "month", out: str = "seq"
) -> DataFrame:
    """Add the 1-based position of each row in its key; ``order`` must be unique within the key."""
    cut = df.withColumn("_bucket", F.date_trunc(grain, F.col(order)))
    counts = cut.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(order))
    return (
        cut.withColumn("_local", local)
        .join(offsets, [*by, "_bucket"])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_local", "_offset")
    )


def block_of(position: Column, rows: int) -> Column:
    return F.floor((position - 1) / F.lit(rows)).cast("long")


def over_blocks(
    df: DataFrame,
    by: Sequence[str],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    back: int = 0,
    ahead: int = 0,
    seq: str = "seq",
    rows: int | None = None,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Run ``compute(frame, window)`` per block, with ``back``/``ahead`` rows of the neighbour blocks.

    ``carry`` is an optional table keyed by (by, _block) that is joined before ``compute`` runs.
    """
    rows = rows or BLOCK_ROWS
    low = F.greatest(block_of(F.col(seq) - ahead, rows), F.lit(0))
    high = block_of(F.col(seq) + back, rows)
    spread = df.withColumn("_home", block_of(F.col(seq), rows)).withColumn(
        "_block", F.explode(F.sequence(low, high))
    )
    if carry is not None:
        spread = spread.join(carry, [*by, "_block"], "left")
    window = Window.partitionBy(*by, "_block").orderBy(seq)
    return compute(spread, window).where("_block = _home").drop("_block", "_home")


def last_before_block(df: DataFrame, by: Sequence[str], value: str, out: str, rows: int | None = None) -> DataFrame:
    """Per (by, _block): the last non-null ``value`` in any earlier block."""
    rows = rows or BLOCK_ROWS
    tails = df.groupBy(*by, block_of(F.col("seq"), rows).alias("_block")).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq"))).alias("_tail")
    )
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return tails.select(*by, "_block", F.last("_tail", ignorenulls=True).over(earlier).alias(out))


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    sums: Mapping[str, Column],
    *,
    position: str = "seq",
    tie: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add sums over all rows of the key up to and including the current one."""
    rows = rows or BLOCK_ROWS
    names = list(sums)
    cut = df.withColumns({f"_v_{n}": F.coalesce(sums[n], F.lit(0.0)) for n in names}).withColumn(
        "_block", block_of(F.col(position), rows)
    )
    totals = cut.groupBy(*by, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *by,
        "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0.0)).alias(f"_c_{n}") for n in names],
    )
    order = [position] + ([tie] if tie else [])
    local = (
        Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.join(carry, [*by, "_block"])
        .withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(local) for n in names})
        .withColumns({n: F.col(f"_r_{n}") + F.col(f"_c_{n}") for n in names})
        .drop("_block", *[f"_{k}_{n}" for k in "vrc" for n in names])
    )
