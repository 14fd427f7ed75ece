"""Writers for the prepared panel, its profile and the experiment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_panel(panel: DataFrame, path: str, months: bool = True) -> None:
    """Parquet partitioned by calendar year and month, so that no symbol is one big folder."""
    out = panel.withColumns({"bar_year": F.year("date"), "bar_month": F.month("date")})
    parts = ["bar_year", "bar_month"] if months else ["bar_year"]
    out.repartition(*parts, "symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy(
        *parts
    ).parquet(path)


def write_panel_csv(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").option("header", True).csv(path)


def write_profile_json(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Predictions, metrics or logs; one folder per experiment and model.

    The folders that ``df`` has rows for are replaced, so a rerun doubles nothing; others stay.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment_key", "model").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All runs written by :func:`write_results`, found by partition discovery."""
    return spark.read.parquet(path)
