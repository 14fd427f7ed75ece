"""Chronological splits, supervised rows and sliding windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.columns import ntz
from panelcast.operators.ordered import number_rows, over_blocks
from panelcast.sources.shared import written

SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class Boundaries:
    """Last dates of train and validation, as text so that they reach the scan as literals."""

    train_end: str
    validation_end: str


def boundary_dates(panel: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """One row (train_end, validation_end) from the distinct dates of all symbols."""
    numbered = number_rows(panel.select("date").where("date is not null").distinct(), [], out="_pos")
    total = F.max("_pos")
    first = F.greatest(F.floor(total * F.lit(train)), F.lit(1))
    second = F.greatest(F.floor(total * F.lit(train + validation)), first)
    ends = numbered.agg(first.alias("_a"), F.least(second, total).alias("_b"))
    picked = numbered.join(F.broadcast(ends), F.col("_pos").isin(F.col("_a"), F.col("_b")))
    return picked.agg(F.min("date").alias("train_end"), F.max("date").alias("validation_end"))


def split_boundaries(panel: DataFrame, train: float = 0.7, validation: float = 0.15) -> Boundaries:
    row = boundary_dates(panel, train, validation).first()
    if row is None or row.train_end is None:
        raise ValueError("no dates to split on")
    return Boundaries(str(row.train_end), str(row.validation_end))


def date_split(bounds: Boundaries, date: str = "date") -> Column:
    return (
        F.when(F.col(date) <= ntz(bounds.train_end), "train")
        .when(F.col(date) <= ntz(bounds.validation_end), "validation")
        .otherwise("test")
    )


def ratio_split(panel: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Split by row position inside each symbol."""
    sizes = written(panel.groupBy("symbol").agg(F.max("seq").alias("_n")), "sizes")
    placed = panel.join(sizes, "symbol")
    return placed.withColumn(
        "split",
        F.when(F.col("seq") <= F.floor(F.col("_n") * F.lit(train)), "train")
        .when(F.col("seq") <= F.floor(F.col("_n") * F.lit(train + validation)), "validation")
        .otherwise("test"),
    ).drop("_n")


def merged_for_refit(df: DataFrame) -> DataFrame:
    """Validation rows join the training rows; no validation rows remain."""
    return df.withColumn("split", F.when(F.col("split") == "validation", "train").otherwise(F.col("split")))


def supervised(
    panel: DataFrame,
    horizon: int = 1,
    price: str = "adjclose",
    target: str = "target",
    extra: Mapping[str, str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Rows with a target ``horizon`` rows ahead inside the same (symbol, split).

    ``extra`` maps further target names to the columns they are read from.
    """
    sources = {target: price, "target_date": "date", **(extra or {})}

    def compute(frame: DataFrame, w: WindowSpec) -> DataFrame:
        same = F.lead("split", horizon).over(w) == F.col("split")
        return frame.withColumns(
            {
                "feature_date": F.col("date"),
                "current_close": F.col(price),
                **{n: F.when(same, F.lead(c, horizon).over(w)) for n, c in sources.items()},
            }
        )

    made = over_blocks(panel, ["symbol"], compute, ahead=horizon, rows=rows)
    return made.dropna(subset=[*sources, "current_close"])


def supervised_positions(samples: DataFrame, panel: DataFrame, horizon: int) -> DataFrame:
    """Add ``pos`` (position among the supervised rows of the symbol) and ``step`` (position in its split).

    Nothing is ordered again: each earlier split lost its last ``horizon`` rows, so both follow from
    ``seq`` and the split sizes.
    """
    sizes = panel.groupBy("symbol").agg(*[F.count_if(F.col("split") == s).alias(f"_{s}") for s in SPLITS[:2]])
    sizes = written(sizes, "split-sizes")
    ahead = {"train": [], "validation": ["_train"], "test": ["_train", "_validation"]}

    def total(cost) -> Column:
        spent = {s: sum((cost(F.col(c)) for c in before), F.lit(0)) for s, before in ahead.items()}
        return F.when(F.col("split") == "train", spent["train"]).when(
            F.col("split") == "validation", spent["validation"]
        ).otherwise(spent["test"])

    return (
        samples.join(sizes, "symbol")
        .withColumn("pos", (F.col("seq") - total(lambda n: F.least(n, F.lit(horizon)))).cast("long"))
        .withColumn("step", (F.col("seq") - total(lambda n: n)).cast("long"))
        .drop("_train", "_validation")
    )


def sliding_windows(
    samples: DataFrame,
    branches: Mapping[str, Sequence[str]],
    length: int,
    seq: str = "pos",
    rows: int | None = None,
) -> DataFrame:
    """Add one array column per branch: the last ``length`` rows of its features, oldest first.

    Windows run over the supervised rows of the symbol, so validation and test windows reach back
    into the split before them. Rows without a full window are dropped.
    """

    def compute(frame: DataFrame, w: WindowSpec) -> DataFrame:
        trailing = w.rowsBetween(-(length - 1), 0)
        made = {
            name: F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(trailing)
            for name, columns in branches.items()
        }
        return frame.withColumns(made)

    first = next(iter(branches))
    out = over_blocks(samples, ["symbol"], compute, back=length - 1, seq=seq, rows=rows)
    return out.where(F.size(first) == length)
