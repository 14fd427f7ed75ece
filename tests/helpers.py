"""Small panels for brute-force comparison."""

import numpy as np
import pandas as pd

PANEL = "symbol string, date timestamp_ntz, seq long, open double, high double, low double, close double, adjclose double, volume double"


def make_panel(sizes: dict[str, int], seed: int = 7) -> pd.DataFrame:
    """Daily random-walk bars; a symbol may hold most of the rows."""
    rng = np.random.default_rng(seed)
    frames = []
    for symbol, n in sizes.items():
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        spread = np.abs(rng.normal(0, 1, n)) + 0.1
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "date": pd.date_range("2024-01-01", periods=n),
                    "seq": np.arange(1, n + 1),
                    "open": close + rng.normal(0, 0.05, n),
                    "high": close + spread,
                    "low": close - spread,
                    "close": close,
                    "adjclose": close,
                    "volume": rng.integers(0, 50, n).astype(float),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, frame: pd.DataFrame, schema: str = PANEL):
    rows = [tuple(None if pd.isna(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in r) for r in frame.itertuples(index=False)]
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows]
    return spark.createDataFrame(rows, schema)


def by_key(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.select(*keys, value).collect()}
