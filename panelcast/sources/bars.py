"""Price bars built from tick tables by one map-side combined aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_bars(
    ticks: DataFrame, symbol: Column, date: Column, price: Column, volume: Column, tie_order: Sequence[str]
) -> DataFrame:
    """First, highest, lowest and last price per (symbol, date); ``volume`` is an aggregate."""
    moment = F.struct(*tie_order)
    shaped = ticks.withColumns({"symbol": symbol, "date": date.cast("timestamp_ntz"), "_price": price})
    return shaped.groupBy("symbol", "date").agg(
        F.min_by("_price", moment).alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", moment).alias("close"),
        F.max_by("_price", moment).alias("adjclose"),
        volume.cast("double").alias("volume"),
    )


def bars_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars, one symbol per event type."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return build_bars(
        events, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), F.count("*"), ["ts", "event_id"]
    )


def bars_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of unit prices, one symbol per brand."""
    part = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    sales = spark.read.parquet(f"{folder}/lineitem.parquet").join(part, "l_partkey")
    return build_bars(
        sales,
        F.col("p_brand"),
        F.col("l_shipdate"),
        F.try_divide("l_extendedprice", "l_quantity"),
        F.sum("l_quantity"),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    )
