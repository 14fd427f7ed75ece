"""Row rules of a bar panel: types, validity, duplicates and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import col, finite, number
from panelcast.sources.shared import written

PRICES = ("open", "high", "low", "close", "adjclose")
NUMERIC = (*PRICES, "volume", "age", "TARGET", "year", "month", "day", "hour", "minute")
TIME_PARTS = ("year", "month", "day", "hour", "minute")
# Leading columns of the prepared panel, in order.
LEADING = (
    "date", "feature_date", "target_date", "symbol", "ticker", "market", "age", "year", "month", "day",
    "hour", "minute", "open", "high", "low", "close", "adjclose", "volume", "TARGET",
    "target_next_close", "target_next_adjclose",
)


def parse_timestamp(df: DataFrame) -> Column:
    """The date column, else its parts (hour and minute default to 0); null where neither reads."""
    readings = []
    if "date" in df.columns:
        readings.append(F.col("date").try_cast("timestamp_ntz"))
    if all(p in df.columns for p in ("year", "month", "day")):
        part = {p: (number(p) if p in df.columns else F.lit(0.0)) for p in TIME_PARTS}
        part["hour"], part["minute"] = F.coalesce(part["hour"], F.lit(0.0)), F.coalesce(part["minute"], F.lit(0.0))
        whole = [part[p].try_cast("int") for p in TIME_PARTS]
        readings.append(F.try_make_timestamp_ntz(*whole, F.lit(0)))
    if not readings:
        return F.lit(None).cast("timestamp_ntz")
    return F.coalesce(*readings)


def coerce_types(df: DataFrame) -> DataFrame:
    """Timestamp first, then numbers; adjclose falls back to close; optional columns are added as null."""
    typed = df.withColumn("date", parse_timestamp(df))
    typed = typed.withColumns({c: number(c) for c in NUMERIC if c in df.columns})
    return fill_optional(typed)


def fill_optional(df: DataFrame) -> DataFrame:
    adjusted = F.coalesce("adjclose", "close") if "adjclose" in df.columns else F.col("close")
    absent = {"market": "string", "age": "double", "TARGET": "double"}
    return df.withColumns(
        {
            "adjclose": adjusted,
            **{c: F.lit(None).cast(t) for c, t in absent.items() if c not in df.columns},
        }
    )


def valid_row() -> Column:
    """Every price present and positive, inside the high-low range; volume absent or not negative."""
    body = [F.col(c) for c in ("open", "close", "adjclose")]
    rule = F.col("date").isNotNull() & F.col("symbol").isNotNull()
    for price in PRICES:
        rule = rule & F.col(price).isNotNull() & (F.col(price) > 0)
    return (
        rule
        & (F.coalesce("volume", F.lit(0.0)) >= 0)
        & (F.col("high") >= F.col("low"))
        & (F.col("high") >= F.greatest(*body))
        & (F.col("low") <= F.least(*body))
    )


def keep_valid(df: DataFrame) -> DataFrame:
    return df.where(valid_row())


def trim_symbol(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol", F.trim(F.col("symbol").cast("string"))).where(F.col("symbol") != "")


def first_of_each(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Per (symbol, date) the first row in input order.

    The aggregate combines before the shuffle, so a date with very many copies stays small.
    """
    rest = [c for c in df.columns if c not in ("symbol", "date")]
    kept = df.groupBy("symbol", "date").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return kept.select("symbol", "date", "_row.*")


def time_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({p: F.date_part(F.lit(p), F.col("date")).cast("int") for p in TIME_PARTS})


def calendar_features(df: DataFrame) -> DataFrame:
    """Calendar columns; Monday is day 0."""
    date = F.col("date")
    return df.withColumns(
        {
            "feature_year": F.year(date),
            "feature_month": F.month(date),
            "feature_day": F.dayofmonth(date),
            "feature_day_of_week": F.weekday(date),
            "feature_is_month_start": (F.dayofmonth(date) == 1).cast("int"),
            "feature_is_month_end": (F.to_date(date) == F.last_day(date)).cast("int"),
            "feature_hour": F.hour(date),
            "feature_minute": F.minute(date),
        }
    )


def canonical_order(df: DataFrame) -> DataFrame:
    first = [c for c in LEADING if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in LEADING])


def least_history(window: int, horizon: int) -> int:
    return max(40, window + horizon + 5)


def enough_history(df: DataFrame, window: int, horizon: int) -> DataFrame:
    """Rows of symbols that are long enough; counts are combined before the shuffle."""
    long_enough = (
        df.groupBy("symbol").count().where(F.col("count") >= least_history(window, horizon)).select("symbol")
    )
    return df.join(written(long_enough, "long-enough"), "symbol", "left_semi")


def null_non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def zero_missing_features(df: DataFrame) -> DataFrame:
    """Feature columns: non-finite to null, null to zero."""
    features = [c for c in df.columns if c.startswith("feature_") and c != "feature_date"]
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(
        {c: F.coalesce(finite(c) if c in numeric else col(c), F.lit(0)) for c in features}
    )


def clean_panel(raw: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """All row rules in sequence: types, validity, symbol, first copy."""
    return first_of_each(trim_symbol(keep_valid(coerce_types(raw))), order).drop(order)


def symbols_of(df: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    named = df.select(F.col("symbol").cast("string").alias("symbol")).where("symbol is not null").distinct()
    return named.where(F.col("symbol").isin(allowed)) if allowed else named
