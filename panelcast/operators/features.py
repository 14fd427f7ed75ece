"""Ordered price and volume features of a numbered panel, all from one exchange per block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.columns import change
from panelcast.operators.ordered import last_before_block, over_blocks

FEATURES = (
    "feature_price_return_1",
    "feature_price_return_5",
    "feature_log_return_1",
    "feature_volume_return_1",
    "feature_intraday_return",
    "feature_high_low_spread",
    "feature_rolling_volatility_5",
    "feature_rolling_volatility_10",
    "feature_rolling_mean_return_5",
)
LONGEST_LOOK_BACK = 11


def _rolling(aggregate, value: Column, window: WindowSpec, length: int) -> Column:
    """Trailing aggregate, null until ``length`` values exist."""
    frame = window.rowsBetween(-(length - 1), 0)
    return F.when(F.count(value).over(frame) == length, aggregate(value).over(frame))


def price_features(panel: DataFrame, price: str = "adjclose", rows: int | None = None) -> DataFrame:
    """Returns, spreads and rolling statistics; columns already present are kept; gaps become 0.0.

    A missing volume stands for the last known one, however long ago that was.
    """
    carry = last_before_block(panel, ["symbol"], "volume", "_older_volume", rows)

    def compute(frame: DataFrame, w: WindowSpec) -> DataFrame:
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        known = F.coalesce(F.last("volume", ignorenulls=True).over(earlier), "_older_volume")
        p = F.col(price)
        stepped = frame.withColumns({"_r1": change(p, F.lag(price, 1).over(w)), "_known": known})
        ratio = F.col("_r1") + 1
        made = {
            "feature_price_return_1": F.col("_r1"),
            "feature_price_return_5": change(p, F.lag(price, 5).over(w)),
            "feature_log_return_1": F.when(ratio > 0, F.ln(ratio)),
            "feature_volume_return_1": change(F.coalesce("volume", "_known"), F.col("_known")),
            "feature_intraday_return": F.try_divide(F.col("close") - F.col("open"), F.col("open")),
            "feature_high_low_spread": F.try_divide(F.col("high") - F.col("low"), p),
            "feature_rolling_volatility_5": _rolling(F.stddev_samp, F.col("_r1"), w, 5),
            "feature_rolling_volatility_10": _rolling(F.stddev_samp, F.col("_r1"), w, 10),
            "feature_rolling_mean_return_5": _rolling(F.avg, F.col("_r1"), w, 5),
        }
        wanted = {n: F.coalesce(c, F.lit(0.0)) for n, c in made.items() if n not in panel.columns}
        return stepped.withColumns(wanted).drop("_r1", "_known", "_older_volume")

    return over_blocks(panel, ["symbol"], compute, back=LONGEST_LOOK_BACK, rows=rows, carry=carry)


def forward_targets(panel: DataFrame, horizon: int, rows: int | None = None) -> DataFrame:
    """Date and prices ``horizon`` rows ahead; null at the end of the symbol."""

    def compute(frame: DataFrame, w: WindowSpec) -> DataFrame:
        return frame.withColumns(
            {
                "feature_date": F.col("date"),
                "target_date": F.lead("date", horizon).over(w),
                "target_next_close": F.lead("close", horizon).over(w),
                "target_next_adjclose": F.lead("adjclose", horizon).over(w),
            }
        )

    return over_blocks(panel, ["symbol"], compute, ahead=horizon, rows=rows)


def percent_log_returns(panel: DataFrame, price: str = "adjclose", rows: int | None = None) -> DataFrame:
    """100 times the change of the log price; the first row of a symbol has none and is dropped."""

    def compute(frame: DataFrame, w: WindowSpec) -> DataFrame:
        level = F.ln(price)
        return frame.withColumn("log_return", 100 * (level - F.lag(level, 1).over(w)))

    return over_blocks(panel, ["symbol"], compute, back=1, rows=rows).where("log_return is not null")
