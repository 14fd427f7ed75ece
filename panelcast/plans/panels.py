"""Prepared panels over the test tables: cleaned, numbered and written once per session and folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.operators.clean import calendar_features, canonical_order, clean_panel, enough_history, fill_optional, keep_valid, time_parts, trim_symbol, zero_missing_features
from panelcast.operators.features import forward_targets, price_features
from panelcast.operators.ordered import number_rows
from panelcast.operators.profile import column_profile, numeric_columns
from panelcast.operators.splits import Boundaries, date_split, split_boundaries, supervised, supervised_positions
from panelcast.sources.bars import bars_from_events, bars_from_lineitem
from panelcast.sources.files import inferred_headers, read_bar_files
from panelcast.sources.shared import written
from panelcast.sources.sinks import write_panel, write_profile_json

SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "events": bars_from_events,
    "lineitem": bars_from_lineitem,
}
WINDOW = 20
_written: dict[tuple, object] = {}


def _once(spark: SparkSession, key: tuple, build: Callable[[], object]):
    full = (spark.sparkContext.applicationId, *key)
    if full not in _written:
        _written[full] = build()
    return _written[full]


def forget(*kinds: str) -> None:
    """Drop the references to written tables of these kinds (all if none), so that the next use builds them again."""
    for key in list(_written):
        if not kinds or any(kind in key for kind in kinds):
            del _written[key]


def prepare(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Bars that pass the row rules, numbered per symbol."""
    bars = written(keep_valid(trim_symbol(SOURCES[source](spark, folder))), f"bars-{source}")
    return number_rows(bars, ["symbol"])


def prepare_dataset(spark: SparkSession, folder: str, path: str, horizon: int = 1) -> DataFrame:
    """Bar files to a prepared panel: read, clean, date parts, calendar, features, targets, canonical order.

    Writes ``panel`` (Parquet), ``headers`` (which file column feeds which logical one, JSON lines) and ``profile``
    (null rates and constants per symbol and column, JSON lines) under ``path`` and returns the panel.
    """
    raw, _ = read_bar_files(spark, folder)
    cleaned = written(clean_panel(raw), "cleaned")
    dated = calendar_features(time_parts(number_rows(cleaned, ["symbol"])))
    made = canonical_order(zero_missing_features(forward_targets(price_features(dated), horizon)))
    write_panel(made, f"{path}/panel")
    write_profile_json(inferred_headers(spark, folder), f"{path}/headers")
    stored = spark.read.parquet(f"{path}/panel")
    write_profile_json(column_profile(stored, numeric_columns(stored)), f"{path}/profile")
    return stored


def panel(spark: SparkSession, folder: str, source: str = "lineitem") -> DataFrame:
    return _once(
        spark, (folder, source, "panel"), lambda: written(prepare(spark, folder, source), f"panel-{source}")
    )


def bounds(spark: SparkSession, folder: str, source: str = "lineitem") -> Boundaries:
    return _once(spark, (folder, source, "bounds"), lambda: split_boundaries(panel(spark, folder, source)))


def split_panel(spark: SparkSession, folder: str, source: str = "lineitem") -> DataFrame:
    return panel(spark, folder, source).withColumn("split", date_split(bounds(spark, folder, source)))


def samples(spark: SparkSession, folder: str, source: str = "lineitem", horizon: int = 1) -> DataFrame:
    """Supervised rows of the symbols with enough history, with their position; written once."""

    def build() -> DataFrame:
        base = enough_history(split_panel(spark, folder, source), WINDOW, horizon)
        made = supervised_positions(supervised(base, horizon), base, horizon)
        return written(made, f"samples-{source}-{horizon}")

    return _once(spark, (folder, source, "samples", horizon), build)


def full_panel(spark: SparkSession, folder: str, source: str = "lineitem") -> DataFrame:
    return fill_optional(panel(spark, folder, source))
