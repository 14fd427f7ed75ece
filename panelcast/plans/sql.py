"""SQL text for checking the queries: common table expressions over the same tables."""

from __future__ import annotations

VALID = """date IS NOT NULL AND symbol IS NOT NULL AND open > 0 AND high > 0 AND low > 0 AND close > 0
  AND adjclose > 0 AND coalesce(volume, 0) >= 0 AND high >= low
  AND high >= greatest(open, close, adjclose) AND low <= least(open, close, adjclose)"""

BARS = {
    "events": """SELECT event_type AS symbol, date_trunc('hour', ts) AS date,
    first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, last(value ORDER BY ts, event_id) AS adjclose,
    count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2""",
    "lineitem": """SELECT p_brand AS symbol, l_shipdate AS date,
    first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
    max(price) AS high, min(price) AS low,
    last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
    last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS adjclose,
    sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY 1, 2""",
}

RAW = """SELECT event_id AS ingest_seq,
    CASE WHEN event_id % 113 = 0 THEN NULL WHEN event_id % 103 = 0 THEN '   ' ELSE ' ' || event_type || ' ' END AS symbol,
    CASE WHEN event_id % 107 = 0 THEN 'not a date' ELSE CAST(date_trunc('hour', ts) AS VARCHAR) END AS date,
    CASE WHEN event_id % 109 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS open,
    CASE WHEN event_id % 101 = 0 THEN value * 0.5 ELSE value * 1.02 END AS high,
    value * 0.98 AS low,
    CASE WHEN event_id % 97 = 0 THEN -value ELSE value END AS close,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 1.01 END AS adjclose,
    CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 89 = 0 THEN -5.0 ELSE user_id::DOUBLE END AS volume
  FROM events"""

TYPED = """SELECT ingest_seq, symbol, TRY_CAST(date AS TIMESTAMP) AS date, TRY_CAST(open AS DOUBLE) AS open,
    high, low, close, coalesce(adjclose, close) AS adjclose, volume FROM raw"""


def rnd(expression: str, digits: int) -> str:
    """Rounded with negative zero folded, as the queries do."""
    return f"CASE WHEN round({expression}, {digits}) = 0 THEN 0.0 ELSE round({expression}, {digits}) END"


def rounded_columns(names: list[str], digits: int) -> str:
    return ", ".join(f"{rnd(n, digits)} AS {n}" for n in names)


def panel(source: str = "lineitem") -> str:
    return f"""WITH bars AS ({BARS[source]}),
panel AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS seq FROM bars WHERE {VALID})"""


def raw() -> str:
    return f"WITH raw AS ({RAW}), typed AS ({TYPED})"


def split_ends(train: float = 0.7, validation: float = 0.15) -> str:
    return f""", days AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, count(*) OVER () AS n
  FROM (SELECT DISTINCT date FROM panel)),
cuts AS (SELECT date, pos, greatest(floor(n * {train}::DOUBLE), 1) AS a,
  least(greatest(floor(n * ({train}::DOUBLE + {validation}::DOUBLE)), greatest(floor(n * {train}::DOUBLE), 1)), n) AS b FROM days),
ends AS (SELECT max(CASE WHEN pos = a THEN date END) AS train_end, max(CASE WHEN pos = b THEN date END) AS validation_end FROM cuts),
split_panel AS (SELECT panel.*, CASE WHEN date <= train_end THEN 'train' WHEN date <= validation_end THEN 'validation' ELSE 'test' END AS split
  FROM panel, ends)"""


def split_panel(source: str = "lineitem") -> str:
    return panel(source) + split_ends()


def samples(source: str = "lineitem", horizon: int = 1, name: str = "samples") -> str:
    return split_panel(source) + sample_tables(horizon, name)


def sample_tables(horizon: int, name: str = "samples") -> str:
    return f""", {name}_led AS (SELECT *, date AS feature_date, adjclose AS current_close,
    lead(adjclose, {horizon}) OVER w AS target, lead(date, {horizon}) OVER w AS target_date
  FROM split_panel WINDOW w AS (PARTITION BY symbol, split ORDER BY date)),
{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos,
    row_number() OVER (PARTITION BY symbol, split ORDER BY date) AS step
  FROM {name}_led WHERE target IS NOT NULL)"""


def clip(column: str, low: str = "lo", high: str = "hi") -> str:
    return f"CASE WHEN {column} < {low} THEN {low} WHEN {column} > {high} THEN {high} ELSE {column} END"


FEATURES = {
    "feature_price_return_1": "coalesce(r1, 0)",
    "feature_price_return_5": "coalesce(adjclose / nullif(lag(adjclose, 5) OVER w, 0) - 1, 0)",
    "feature_log_return_1": "CASE WHEN r1 + 1 > 0 THEN ln(r1 + 1) ELSE 0 END",
    "feature_volume_return_1": "coalesce(filled / nullif(lag(filled, 1) OVER w, 0) - 1, 0)",
    "feature_intraday_return": "coalesce((close - open) / nullif(open, 0), 0)",
    "feature_high_low_spread": "coalesce((high - low) / nullif(adjclose, 0), 0)",
    "feature_rolling_volatility_5": "coalesce(CASE WHEN count(r1) OVER w5 = 5 THEN stddev_samp(r1) OVER w5 END, 0)",
    "feature_rolling_volatility_10": "coalesce(CASE WHEN count(r1) OVER w10 = 10 THEN stddev_samp(r1) OVER w10 END, 0)",
    "feature_rolling_mean_return_5": "coalesce(CASE WHEN count(r1) OVER w5 = 5 THEN avg(r1) OVER w5 END, 0)",
}


def feature_table(base: str = "panel", volume: str = "volume", name: str = "featured") -> str:
    made = ",\n    ".join(f"{e} AS {n}" for n, e in FEATURES.items())
    return f""", {name}_steps AS (SELECT *, adjclose / nullif(lag(adjclose, 1) OVER w, 0) - 1 AS r1,
    last_value({volume} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS filled
  FROM {base} WINDOW w AS (PARTITION BY symbol ORDER BY date)),
{name} AS (SELECT *, {made}
  FROM {name}_steps WINDOW w AS (PARTITION BY symbol ORDER BY date),
    w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING))"""


_WHOLE = "CASE WHEN count(predicted) = count(*) THEN {} END"
METRICS = {
    "mae": _WHOLE.format("avg(abs(actual_close - predicted))"),
    "mse": _WHOLE.format("avg((actual_close - predicted) ** 2)"),
    "rmse": _WHOLE.format("sqrt(avg((actual_close - predicted) ** 2))"),
    "smape": _WHOLE.format("avg(2 * abs(actual_close - predicted) / greatest(abs(actual_close) + abs(predicted), 1e-8))"),
    "da": "avg(CASE WHEN moved <> 0 THEN CASE WHEN guessed = moved THEN 1.0 ELSE 0.0 END END)",
    "direction_count": "count(*) FILTER (WHERE moved <> 0)",
    "up_precision": "count(*) FILTER (WHERE moved = 1 AND guessed = 1) / nullif(count(*) FILTER (WHERE moved <> 0 AND guessed = 1), 0)",
    "up_recall": "count(*) FILTER (WHERE moved = 1 AND guessed = 1) / nullif(count(*) FILTER (WHERE moved = 1), 0)",
    "down_precision": "count(*) FILTER (WHERE moved = -1 AND guessed = -1) / nullif(count(*) FILTER (WHERE moved <> 0 AND guessed = -1), 0)",
    "down_recall": "count(*) FILTER (WHERE moved = -1 AND guessed = -1) / nullif(count(*) FILTER (WHERE moved = -1), 0)",
}


def metric_table(source: str, keys: str, name: str = "metrics") -> str:
    made = ", ".join(f"{e} AS {n}" for n, e in METRICS.items())
    f1 = ", ".join(f"2 * {s}_precision * {s}_recall / nullif({s}_precision + {s}_recall, 0) AS {s}_f1" for s in ("up", "down"))
    return f""", {name}_base AS (SELECT {keys}, {made} FROM (SELECT *, sign(actual_close - current_close) AS moved,
    sign(predicted - current_close) AS guessed FROM {source}) GROUP BY {keys}),
{name} AS (SELECT *, {f1} FROM {name}_base)"""


# The columns of a prediction table, in order.
PREDICTION_COLUMNS = (
    "feature_date", "target_date", "symbol", "date", "current_close", "actual_close", "predicted", "abs_error",
    "direction_correct", "model", "evaluation", "step", "split_start_date", "feature_count", "feature_set",
    "prediction_horizon", "window_size", "price_column", "experiment_key",
)


def model_tables(horizon: int) -> str:
    """Forecasts of the three SQL-checkable models at one horizon, both evaluations."""
    h, t = horizon, f"h{horizon}"
    powers = " + ".join(f"power(phi, {i})" for i in range(1, h + 1))
    level, total = "r0", []
    for _ in range(h):
        level = f"(c + slope * {level})"
        total.append(level)
    return sample_tables(h, f"s{t}") + f""",
lim_{t} AS (SELECT symbol, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi FROM s{t} WHERE split = 'train' GROUP BY 1),
lr_{t} AS (SELECT s.*, {clip('close')} AS x FROM s{t} s JOIN lim_{t} USING (symbol)),
lrm_{t} AS (SELECT symbol, regr_slope(target, x) AS slope, regr_intercept(target, x) AS c FROM lr_{t} WHERE split <> 'test' GROUP BY 1),
lrw_{t} AS (SELECT *, regr_slope(target, close) OVER e AS slope, regr_intercept(target, close) OVER e AS c FROM s{t}
  WINDOW e AS (PARTITION BY symbol ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND {h} PRECEDING)),
diff_{t} AS (SELECT symbol, date, split, seq, d, lag(d) OVER w AS d1 FROM (SELECT symbol, date, split, seq,
  adjclose - lag(adjclose) OVER (PARTITION BY symbol ORDER BY date) AS d FROM split_panel) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
arm_{t} AS (SELECT symbol, sum(d * d1) / sum(d1 * d1) AS phi FROM diff_{t} WHERE split <> 'test' GROUP BY 1),
arw_{t} AS (SELECT symbol, date, d, sum(d * d1) OVER e / sum(d1 * d1) OVER e AS phi FROM diff_{t}
  WINDOW e AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
ret_{t} AS (SELECT symbol, date, r0, lag(r0) OVER w AS rb FROM (SELECT symbol, date,
  100 * (ln(adjclose) - lag(ln(adjclose)) OVER (PARTITION BY symbol ORDER BY date)) AS r0 FROM split_panel) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
rm_{t} AS (SELECT symbol, date, r0, regr_slope(r0, rb) OVER e AS slope, regr_intercept(r0, rb) OVER e AS c FROM ret_{t}
  WINDOW e AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
out_{t} AS (
  SELECT s.symbol, feature_date, target_date, current_close, target, step, 'linear_regression' AS model, 'holdout' AS evaluation,
    1 AS feature_count, 'close' AS feature_set, c + slope * x AS predicted FROM lr_{t} s JOIN lrm_{t} USING (symbol) WHERE split = 'test'
  UNION ALL SELECT symbol, feature_date, target_date, current_close, target, step, 'linear_regression', 'walk_forward', 1, 'close',
    c + slope * close FROM lrw_{t} WHERE split = 'test'
  UNION ALL SELECT s.symbol, feature_date, target_date, current_close, target, step, 'arima', 'holdout', 1, 'adjclose',
    current_close + d * ({powers}) FROM s{t} s JOIN diff_{t} f ON f.symbol = s.symbol AND f.date = s.date JOIN arm_{t} a ON a.symbol = s.symbol WHERE s.split = 'test'
  UNION ALL SELECT s.symbol, feature_date, target_date, current_close, target, step, 'arima', 'walk_forward', 1, 'adjclose',
    current_close + d * ({powers}) FROM s{t} s JOIN arw_{t} f ON f.symbol = s.symbol AND f.date = s.date WHERE s.split = 'test'
  UNION ALL SELECT s.symbol, feature_date, target_date, current_close, target, step, 'garch_return', e, 1, 'adjclose_returns',
    current_close * exp(({' + '.join(total)}) / 100) FROM s{t} s JOIN rm_{t} f ON f.symbol = s.symbol AND f.date = s.date,
    (VALUES ('holdout'), ('walk_forward')) v(e) WHERE s.split = 'test'),
pred_{t} AS (SELECT feature_date, target_date, symbol, target_date AS date, current_close, target AS actual_close, predicted,
  abs(target - predicted) AS abs_error,
  CASE WHEN predicted IS NOT NULL AND sign(target - current_close) <> 0 THEN sign(predicted - current_close) = sign(target - current_close) END AS direction_correct,
  model, evaluation, step::INTEGER AS step, min(feature_date) OVER (PARTITION BY symbol, model, evaluation) AS split_start_date,
  feature_count, feature_set, {h} AS prediction_horizon, 20 AS window_size, 'adjclose' AS price_column, 'adjclose_h{h}_w20' AS experiment_key
  FROM out_{t})"""


METRIC_KEYS = "symbol, model, evaluation, feature_count, feature_set, price_column, prediction_horizon, window_size, experiment_key"


def predictions(source: str = "lineitem", horizons: tuple[int, ...] = (1, 5)) -> str:
    parts = "".join(model_tables(h) for h in horizons)
    union = " UNION ALL ".join(f"SELECT * FROM pred_h{h}" for h in horizons)
    return split_panel(source) + parts + f", predictions AS ({union})"


def metrics(source: str = "lineitem", horizons: tuple[int, ...] = (1, 5)) -> str:
    return predictions(source, horizons) + metric_table("predictions", METRIC_KEYS)


SUMMARY_KEYS = "evaluation, experiment_key, price_column, prediction_horizon, window_size, model"


def summary(source: str = "lineitem") -> str:
    made = ["count(*) AS count"]
    for m in ("rmse", "mae", "smape"):
        made += [f"round(avg({m}), 6) AS mean_{m}", f"round(median({m}), 6) AS median_{m}"]
    made += [f"round(avg({m}), 6) AS mean_{m}" for m in ("da", "up_precision", "up_recall", "up_f1", "down_precision", "down_recall", "down_f1")]
    made += ["arg_min(symbol, (rmse, symbol)) AS best_symbol", "arg_max(symbol, (rmse, symbol)) AS worst_symbol"]
    return metrics(source) + f""", summary AS (SELECT {SUMMARY_KEYS}, {', '.join(made)} FROM metrics
  WHERE rmse IS NOT NULL AND mae IS NOT NULL GROUP BY {SUMMARY_KEYS}),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY experiment_key, evaluation ORDER BY mean_rmse) AS rank FROM summary),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_key, evaluation ORDER BY mean_rmse, median_rmse, model) AS place FROM summary) WHERE place = 1)"""


def compared(models: tuple[str, ...], source: str = "lineitem") -> str:
    keys = "experiment_key, evaluation, symbol, date, feature_date, target_date, current_close, actual_close, split_start_date, prediction_horizon, window_size, price_column"
    made = ", ".join(
        f"max(CASE WHEN model = '{m}' THEN predicted END) AS pred_{m}, max(CASE WHEN model = '{m}' THEN abs_error END) AS abs_error_{m}, "
        f"bool_or(CASE WHEN model = '{m}' THEN direction_correct END) AS dir_correct_{m}"
        for m in models
    )
    return predictions(source) + f", compared AS (SELECT {keys}, {made} FROM predictions GROUP BY {keys})"


def flagged(models: tuple[str, ...], source: str = "lineitem", level: float = 0.95) -> str:
    return compared(models, source) + f""", one AS (SELECT *, abs((actual_close - current_close) / nullif(current_close, 0)) AS abs_return_1d
  FROM compared),
limits AS (SELECT experiment_key, evaluation, symbol, quantile_cont(abs_return_1d, {level}) AS q FROM one GROUP BY 1, 2, 3),
flagged AS (SELECT one.*, coalesce(abs_return_1d >= q, false) AS is_extreme_volatility FROM one JOIN limits USING (experiment_key, evaluation, symbol))"""
