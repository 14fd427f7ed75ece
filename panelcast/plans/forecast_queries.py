"""Queries over splits, fitted transforms and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.columns import rounded
from panelcast.operators import autoregression as ar
from panelcast.operators import features, sequence, splits, transforms, two_stage, volatility
from panelcast.operators.evaluate import experiment_key, metrics, prediction_rows, first_test_dates
from panelcast.operators.expanding_bounds import walk_forward_refit_bounds
from panelcast.operators.regression import linear_holdout, selection_log, walk_forward_linear
from panelcast.operators.report import missing_runs
from panelcast.plans import sql
from panelcast.plans.catalogue import query
from panelcast.plans.experiments import WINDOW, arima_forecasts, attach_forecast, prediction_cells, predictions, run_cells
from panelcast.plans.panels import panel, samples, split_panel
from panelcast.config import MODELS, Settings
from panelcast.sources.shared import new_path

RND = sql.rnd
KEYS = ["symbol", "feature_date", "target_date", "step"]


def forecast_rows(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*KEYS, "target", rounded("predicted", digits).alias("predicted"))


ROUGH = f"symbol, feature_date, target_date, step, target, {RND('predicted', 1)} AS predicted"
FORECAST = f"symbol, feature_date, target_date, step, target, {RND('predicted', 2)} AS predicted"


# ---- splits ----------------------------------------------------------------------------------------


@query("e1_boundary_dates", sql.split_panel() + " SELECT * FROM ends")
def e1_boundary_dates(spark: SparkSession, folder: str) -> DataFrame:
    return splits.boundary_dates(panel(spark, folder))


@query("e2_date_split", sql.split_panel() + " SELECT symbol, split, count(*) AS n, min(date) AS first, max(date) AS last FROM split_panel GROUP BY 1, 2")
def e2_date_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = split_panel(spark, folder)
    return rows.groupBy("symbol", "split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    "e3_ratio_split",
    sql.panel() + """, sized AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM panel)
    SELECT symbol, date, CASE WHEN seq <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN seq <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM sized""",
)
def e3_ratio_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.ratio_split(panel(spark, folder)).select("symbol", "date", "split")


def _supervised_query(horizon: int) -> None:
    text = sql.samples(horizon=horizon) + " SELECT symbol, date, split, seq, pos, step, current_close, target, target_date FROM samples"

    @query(f"e4_supervised_h{horizon}", text)
    def build(spark: SparkSession, folder: str) -> DataFrame:
        base = split_panel(spark, folder)
        made = splits.supervised_positions(splits.supervised(base, horizon), base, horizon)
        return made.select("symbol", "date", "split", "seq", "pos", "step", "current_close", "target", "target_date")


for _h in (1, 5):
    _supervised_query(_h)


@query(
    "e5_extra_targets",
    sql.split_panel() + """ SELECT symbol, date, target, target_volume FROM (SELECT symbol, date, lead(adjclose) OVER w AS target,
    lead(volume) OVER w AS target_volume FROM split_panel WINDOW w AS (PARTITION BY symbol, split ORDER BY date)) WHERE target IS NOT NULL""",
)
def e5_extra_targets(spark: SparkSession, folder: str) -> DataFrame:
    made = splits.supervised(split_panel(spark, folder), 1, extra={"target_volume": "volume"})
    return made.select("symbol", "date", "target", "target_volume")


_WINDOWED = sql.samples() + """, windowed AS (SELECT symbol, feature_date, split, target AS y, list([close, volume]) OVER w AS x, list([open]) OVER w AS opens
  FROM samples WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING))"""
_FLAT = "array_to_string([round(v, 6)::VARCHAR for v in flatten({})], ',')"


def _array_sums(name: str) -> list:
    """Scalars that pin an array of rows down: its length, first and last row and position-weighted total."""
    flat = F.flatten(name)
    weighted = F.aggregate(
        F.transform(flat, lambda v, i: v * (i + 1)), F.lit(0.0), lambda t, v: t + v
    )
    return [
        F.size(name).cast("long").alias(f"{name}_rows"),
        flat[0].alias(f"{name}_first"),
        F.element_at(flat, -1).alias(f"{name}_last"),
        rounded(weighted, 2).alias(f"{name}_weighted"),
    ]


def _array_sums_sql(name: str) -> str:
    flat = f"flatten({name})"
    weighted = f"list_sum([v * i for v, i in {flat}])"
    return (
        f"len({name})::BIGINT AS {name}_rows, {flat}[1] AS {name}_first, {flat}[-1] AS {name}_last, {RND(weighted, 2)} AS {name}_weighted"
    )


@query("e6_train_windows", _WINDOWED + f" SELECT symbol, feature_date, y, {_array_sums_sql('x')} FROM windowed WHERE split = 'train' AND len(x) = 10")
def e6_train_windows(spark: SparkSession, folder: str) -> DataFrame:
    made = splits.sliding_windows(samples(spark, folder), {"x": ["close", "volume"]}, 10).where("split = 'train'")
    return made.select("symbol", "feature_date", F.col("target").alias("y"), *_array_sums("x"))


@query("e7_contextual_windows", _WINDOWED + f" SELECT symbol, feature_date, split, y, {_array_sums_sql('x')} FROM windowed WHERE split <> 'train' AND len(x) = 10")
def e7_contextual_windows(spark: SparkSession, folder: str) -> DataFrame:
    made = splits.sliding_windows(samples(spark, folder), {"x": ["close", "volume"]}, 10).where("split <> 'train'")
    return made.select("symbol", "feature_date", "split", F.col("target").alias("y"), *_array_sums("x"))


@query(
    "e8_inference_windows",
    _WINDOWED + f""" SELECT symbol, feature_date, {_array_sums_sql('x')} FROM windowed WHERE len(x) = 10
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY feature_date DESC) = 1""",
)
def e8_inference_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = samples(spark, folder)
    ends = rows.groupBy("symbol").agg(F.max("pos").alias("_end"))
    tails = rows.join(ends, "symbol").where(F.col("pos") > F.col("_end") - 10)
    made = splits.sliding_windows(tails, {"x": ["close", "volume"]}, 10).where("pos = _end")
    return made.select("symbol", "feature_date", *_array_sums("x"))


@query(
    "e9_branch_windows",
    _WINDOWED + f" SELECT symbol, feature_date, split, y, {_array_sums_sql('x')}, {_array_sums_sql('opens')} FROM windowed WHERE len(x) = 10",
)
def e9_branch_windows(spark: SparkSession, folder: str) -> DataFrame:
    made = splits.sliding_windows(samples(spark, folder), {"x": ["close", "volume"], "opens": ["open"]}, 10)
    return made.select("symbol", "feature_date", "split", F.col("target").alias("y"), *_array_sums("x"), *_array_sums("opens"))


@query("e10_refit_split", sql.samples() + " SELECT symbol, CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM samples GROUP BY 1, 2")
def e10_refit_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.merged_for_refit(samples(spark, folder)).groupBy("symbol", "split").agg(F.count("*").alias("n"))


# ---- transforms ------------------------------------------------------------------------------------

_FITTED = ["close", "volume"]
_BOUNDS = sql.samples() + """, gaps AS (SELECT symbol, feature_date, split, target, close, CASE WHEN seq % 11 = 0 THEN NULL ELSE volume END AS volume FROM samples),
bounds AS (SELECT symbol, """ + ", ".join(
    f"quantile_cont({c}, 0.01) AS {c}__lo, quantile_cont({c}, 0.99) AS {c}__hi" for c in _FITTED
) + " FROM gaps WHERE split = 'train' GROUP BY 1), clipped AS (SELECT g.* REPLACE (" + ", ".join(
    f"{sql.clip('g.' + c, c + '__lo', c + '__hi')} AS {c}" for c in _FITTED
) + "), " + ", ".join(f"{c}__lo, {c}__hi" for c in _FITTED) + """ FROM gaps g JOIN bounds USING (symbol)),
medians AS (SELECT symbol, """ + ", ".join(f"median({c}) AS {c}__median" for c in _FITTED) + """ FROM clipped WHERE split = 'train' GROUP BY 1),
filled AS (SELECT c.* REPLACE (""" + ", ".join(f"coalesce({c}, {c}__median, 0) AS {c}" for c in _FITTED) + """) FROM clipped c JOIN medians USING (symbol)),
moments AS (SELECT symbol, """ + ", ".join(f"avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__std" for c in _FITTED) + """ FROM filled WHERE split = 'train' GROUP BY 1),
scaled AS (SELECT symbol, feature_date, split, target, """ + ", ".join(
    f"({c} - {c}__mean) / CASE WHEN {c}__std > 0 THEN {c}__std ELSE 1 END AS {c}" for c in _FITTED
) + " FROM filled JOIN moments USING (symbol))"


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).withColumn("volume", F.when(F.col("seq") % 11 != 0, F.col("volume")))


_BRANCHES = {"x": ["close", "volume"], "opens": ["open"]}
_THREE = ["close", "volume", "open"]


@query(
    "e9_scaled_branch_windows",
    sql.samples() + ", lims AS (SELECT symbol, " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_l, quantile_cont({c}, 0.99) AS {c}_h" for c in _THREE)
    + " FROM samples WHERE split = 'train' GROUP BY 1), cut AS (SELECT s.symbol, feature_date, split, " + ", ".join(f"{sql.clip(c, c + '_l', c + '_h')} AS {c}" for c in _THREE)
    + " FROM samples s JOIN lims USING (symbol)), size AS (SELECT symbol, " + ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS {c}_s" for c in _THREE)
    + " FROM cut WHERE split = 'train' GROUP BY 1), even AS (SELECT c.symbol, feature_date, split, " + ", ".join(f"({c} - {c}_m) / {c}_s AS {c}" for c in _THREE)
    + """ FROM cut c JOIN size USING (symbol)), summed AS (SELECT symbol, feature_date, split, close AS newest, sum(close + volume) OVER w AS x, sum(open) OVER w AS opens, count(*) OVER w AS n
      FROM even WINDOW w AS (PARTITION BY symbol ORDER BY feature_date ROWS 9 PRECEDING))
    SELECT symbol, feature_date, split, """ + f"{RND('newest', 6)} AS newest, {RND('x', 5)} AS x, {RND('opens', 5)} AS opens FROM summed WHERE n = 10",
)
def e9_scaled_branch_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of two branches on scaled rows: newest close and the sums of both branches."""
    made = transforms.scaled_branch_windows(samples(spark, folder), _BRANCHES, 10)
    total = {b: F.aggregate(F.flatten(b), F.lit(0.0), lambda a, v: a + v) for b in _BRANCHES}
    newest = F.element_at("x", -1)[0]
    return made.select("symbol", "feature_date", "split", rounded(newest, 6).alias("newest"), *[rounded(t, 5).alias(b) for b, t in total.items()])


@query(
    "f1_clip_bounds",
    _BOUNDS + " SELECT symbol, " + sql.rounded_columns([f"{c}__{k}" for c in _FITTED for k in ("lo", "hi")], 7) + " FROM bounds",
)
def f1_clip_bounds(spark: SparkSession, folder: str) -> DataFrame:
    made = transforms.fit_bounds(_gaps(spark, folder).where("split = 'train'"), _FITTED)
    return made.select("symbol", *[rounded(f"{c}__{k}", 7).alias(f"{c}__{k}") for c in _FITTED for k in ("lo", "hi")])


@query("f2_clipped_rows", _BOUNDS + " SELECT symbol, feature_date, split, " + sql.rounded_columns(_FITTED, 8) + " FROM clipped")
def f2_clipped_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _gaps(spark, folder)
    fitted = transforms.fit_bounds(rows.where("split = 'train'"), _FITTED)
    made = transforms.clipped(rows.join(fitted, "symbol"), _FITTED)
    return made.select("symbol", "feature_date", "split", *[rounded(c, 8).alias(c) for c in _FITTED])


@query("f3_filled_rows", _BOUNDS + " SELECT symbol, feature_date, split, " + sql.rounded_columns(_FITTED, 8) + " FROM filled")
def f3_filled_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _gaps(spark, folder)
    fitted = transforms.fit_bounds(rows.where("split = 'train'"), _FITTED)
    made = transforms.clipped(rows.join(fitted, "symbol"), _FITTED)
    return made.select("symbol", "feature_date", "split", *[rounded(transforms.filled(c), 8).alias(c) for c in _FITTED])


@query("f4_scaled_rows", _BOUNDS + " SELECT symbol, feature_date, split, " + sql.rounded_columns(_FITTED, 6) + " FROM scaled")
def f4_scaled_rows(spark: SparkSession, folder: str) -> DataFrame:
    made = transforms.fit_and_scale(_gaps(spark, folder), _FITTED)
    return made.select("symbol", "feature_date", "split", *[rounded(c, 6).alias(c) for c in _FITTED])


@query("f5_dense_rows", _BOUNDS + " SELECT symbol, feature_date, split, close AS x0, volume AS x1, target AS y, close IS NOT NULL AND volume IS NOT NULL AS complete FROM gaps")
def f5_dense_rows(spark: SparkSession, folder: str) -> DataFrame:
    made = transforms.dense_rows(_gaps(spark, folder), _FITTED)
    return made.select("symbol", "feature_date", "split", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "y", "complete")


@query(
    "f6_scaled_windows",
    _BOUNDS + f""", windowed AS (SELECT symbol, feature_date, split, list([close, volume]) OVER (PARTITION BY symbol ORDER BY feature_date ROWS 4 PRECEDING) AS x FROM scaled)
    SELECT symbol, feature_date, split, len(x)::BIGINT AS x_rows, {RND('list_sum([v * i for v, i in flatten(x)])', 6)} AS x_weighted FROM windowed WHERE len(x) = 5""",
)
def f6_scaled_windows(spark: SparkSession, folder: str) -> DataFrame:
    scaled = transforms.fit_and_scale(_gaps(spark, folder), _FITTED)
    made = splits.sliding_windows(scaled, {"x": _FITTED}, 5)
    weighted = F.aggregate(F.transform(F.flatten("x"), lambda v, i: v * (i + 1)), F.lit(0.0), lambda t, v: t + v)
    return made.select("symbol", "feature_date", "split", F.size("x").cast("long").alias("x_rows"), rounded(weighted, 6).alias("x_weighted"))


# ---- linear regression -----------------------------------------------------------------------------

_SIX = ["open", "high", "low", "close", "adjclose", "volume"]


def _two_columns(table: str, where: str, name: str) -> str:
    """Two-feature least squares by Cramer's rule."""
    return f""", {name}_m AS (SELECT symbol, avg(x1) AS m1, avg(x2) AS m2, avg(target) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22,
    covar_pop(x1, x2) AS s12, covar_pop(x1, target) AS s1y, covar_pop(x2, target) AS s2y FROM {table} WHERE {where} GROUP BY 1),
{name} AS (SELECT symbol, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM {name}_m)"""


CLIPPED_TWO = sql.samples() + """, lim AS (SELECT symbol, quantile_cont(close, 0.01) AS l1, quantile_cont(close, 0.99) AS h1, quantile_cont(volume, 0.01) AS l2,
  quantile_cont(volume, 0.99) AS h2 FROM samples WHERE split = 'train' GROUP BY 1),
ready AS (SELECT s.*, """ + f"{sql.clip('close', 'l1', 'h1')} AS x1, {sql.clip('volume', 'l2', 'h2')} AS x2" + " FROM samples s JOIN lim USING (symbol))"


@query(
    "g1_linear_holdout",
    CLIPPED_TWO + _two_columns("ready", "split <> 'test'", "fit") + f""", scored AS (SELECT r.*, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS predicted
    FROM ready r JOIN fit USING (symbol) WHERE split = 'test') SELECT {FORECAST} FROM scored""",
)
def g1_linear_holdout(spark: SparkSession, folder: str) -> DataFrame:
    return forecast_rows(linear_holdout(samples(spark, folder), ["close", "volume"]))


@query("g1_linear_holdout_six_columns")
def g1_linear_holdout_six_columns(spark: SparkSession, folder: str) -> DataFrame:
    return forecast_rows(linear_holdout(samples(spark, folder), _SIX))


@query(
    "g1_selection_log",
    CLIPPED_TWO + _two_columns("ready", "split = 'train'", "fit") + f""", scored AS (SELECT r.*, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS predicted
    FROM ready r JOIN fit USING (symbol) WHERE split = 'validation')
    SELECT symbol, 'selection' AS phase, count(predicted) AS n, {RND('sqrt(avg((target - predicted) ** 2))', 4)} AS rmse FROM scored GROUP BY 1""",
)
def g1_selection_log(spark: SparkSession, folder: str) -> DataFrame:
    return selection_log(samples(spark, folder), ["close", "volume"]).withColumn("rmse", rounded("rmse", 4))


@query(
    "g2_scaled_linear_holdout",
    CLIPPED_TWO + _two_columns("ready", "split <> 'test'", "fit") + f""", scored AS (SELECT r.*, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS predicted
    FROM ready r JOIN fit USING (symbol) WHERE split = 'test') SELECT {FORECAST} FROM scored""",
)
def g2_scaled_linear_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Scaling does not change least-squares forecasts, so the unscaled SQL checks this one too."""
    scaled = transforms.fit_and_scale(samples(spark, folder), ["close", "volume"])
    return forecast_rows(linear_holdout(scaled, ["close", "volume"], limits=(0.0, 1.0)))


def _expanding_sql(horizon: int) -> str:
    frame = f"WINDOW e AS (PARTITION BY symbol ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND {horizon} PRECEDING)"
    return sql.samples(horizon=horizon) + f""", scored AS (SELECT *, regr_intercept(target, close) OVER e + regr_slope(target, close) OVER e * close AS predicted
    FROM samples {frame}) SELECT {FORECAST} FROM scored WHERE split = 'test'"""


def _walk_forward_query(horizon: int) -> None:
    @query(f"g11_walk_forward_linear_h{horizon}", _expanding_sql(horizon))
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return forecast_rows(walk_forward_linear(samples(spark, folder, horizon=horizon), ["close"], horizon, limits=None))


for _h in (1, 5):
    _walk_forward_query(_h)


@query(
    "g11_walk_forward_open_history_h5",
    sql.samples(horizon=5) + f""", scored AS (SELECT *, regr_intercept(target, close) OVER e + regr_slope(target, close) OVER e * close AS predicted
    FROM samples WINDOW e AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT {FORECAST} FROM scored WHERE split = 'test'""",
)
def g11_walk_forward_open_history_h5(spark: SparkSession, folder: str) -> DataFrame:
    """History of all earlier rows, whether or not their targets were known yet."""
    return forecast_rows(walk_forward_linear(samples(spark, folder, horizon=5), ["close"], 5, limits=None, leak_safe=False))


@query("g11_walk_forward_linear_six_columns")
def g11_walk_forward_linear_six_columns(spark: SparkSession, folder: str) -> DataFrame:
    return forecast_rows(walk_forward_linear(samples(spark, folder), _SIX))


_REFIT = sql.samples() + f""", asked AS (SELECT symbol, pos, step, feature_date, target_date, target, close, volume FROM samples WHERE split = 'test'),
    history AS (SELECT a.symbol, a.step, s.close, s.volume, s.target FROM asked a JOIN samples s ON s.symbol = a.symbol AND s.pos < a.pos),
    lim AS (SELECT symbol, step, quantile_cont(close, 0.01) AS l1, quantile_cont(close, 0.99) AS h1, quantile_cont(volume, 0.01) AS l2,
      quantile_cont(volume, 0.99) AS h2 FROM history GROUP BY 1, 2),
    clipped AS (SELECT h.symbol, h.step, target, {sql.clip('h.close', 'l1', 'h1')} AS x1, {sql.clip('h.volume', 'l2', 'h2')} AS x2 FROM history h JOIN lim USING (symbol, step)),
    own AS (SELECT a.*, {sql.clip('a.close', 'l1', 'h1')} AS x1, {sql.clip('a.volume', 'l2', 'h2')} AS x2 FROM asked a JOIN lim USING (symbol, step))"""


@query(
    "g11_walk_forward_refit_bounds",
    _REFIT + f""", fit AS (SELECT symbol, step, regr_slope(target, x1) AS b, regr_intercept(target, x1) AS c FROM clipped GROUP BY 1, 2),
    scored AS (SELECT o.*, c + b * x1 AS predicted FROM own o JOIN fit USING (symbol, step))
    SELECT {FORECAST} FROM scored""",
)
def g11_walk_forward_refit_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return forecast_rows(walk_forward_refit_bounds(samples(spark, folder), ["close"]))


@query(
    "g11_walk_forward_refit_bounds_two_columns",
    _REFIT + f""", fit_m AS (SELECT symbol, step, avg(x1) AS m1, avg(x2) AS m2, avg(target) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22,
      covar_pop(x1, x2) AS s12, covar_pop(x1, target) AS s1y, covar_pop(x2, target) AS s2y FROM clipped GROUP BY 1, 2),
    scored AS (SELECT o.*, my + (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) * (x1 - m1) + (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) * (x2 - m2) AS predicted
      FROM own o JOIN fit_m USING (symbol, step))
    SELECT {FORECAST} FROM scored""",
)
def g11_walk_forward_refit_bounds_two_columns(spark: SparkSession, folder: str) -> DataFrame:
    return forecast_rows(walk_forward_refit_bounds(samples(spark, folder), ["close", "volume"]))


# ---- autoregression --------------------------------------------------------------------------------

_DIFFS = """, diffs AS (SELECT symbol, date, split, seq, adjclose, d, """ + ", ".join(
    f"lag(d, {i}) OVER w AS d{i}" for i in range(1, 3)
) + """ FROM (SELECT symbol, date, split, seq, adjclose, adjclose - lag(adjclose) OVER (PARTITION BY symbol ORDER BY date) AS d FROM split_panel)
  WINDOW w AS (PARTITION BY symbol ORDER BY date))"""
_TWO_LAGS = """(SELECT symbol, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS phi1, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS phi2
  FROM (SELECT symbol, sum(d1 * d1) AS a11, sum(d1 * d2) AS a12, sum(d2 * d2) AS a22, sum(d1 * d) AS b1, sum(d2 * d) AS b2 FROM diffs
    WHERE d2 IS NOT NULL AND {} GROUP BY 1))"""


@query(
    "g3_ar_coefficients",
    sql.split_panel() + _DIFFS + f""" SELECT symbol, '(1, 1, 0)' AS "order", {RND('sum(d * d1) / sum(d1 * d1)', 6)} AS phi1, 0.0::DOUBLE AS phi2
    FROM diffs WHERE split = 'train' GROUP BY 1
    UNION ALL SELECT symbol, '(2, 1, 0)', {RND('phi1', 6)}, {RND('phi2', 6)} FROM {_TWO_LAGS.format("split = 'train'")}""",
)
def g3_ar_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    lagged = ar.differenced(split_panel(spark, folder), deepest=ar.AR_TERMS)
    fitted = ar.fit_orders(lagged.where("split = 'train'"), ((1, 1, 0), (2, 1, 0)))
    return fitted.select("symbol", "order", rounded(F.col("phi")[0], 6).alias("phi1"), rounded(F.col("phi")[1], 6).alias("phi2"))


@query(
    "g4_rolling_forecast",
    sql.split_panel() + _DIFFS + f""", fit AS (SELECT symbol, sum(d * d1) / sum(d1 * d1) AS phi FROM diffs WHERE split <> 'test' GROUP BY 1),
    made AS (SELECT symbol, date, seq, adjclose - d + phi * coalesce(d1, 0) AS linear_current, adjclose + phi * coalesce(d, 0) AS linear_next, adjclose FROM diffs JOIN fit USING (symbol))
    SELECT symbol, seq, {RND('linear_next', 2)} AS linear_next, {RND('linear_current', 2)} AS linear_current, {RND('adjclose - linear_current', 2)} AS linear_residual FROM made""",
)
def g4_rolling_forecast(spark: SparkSession, folder: str) -> DataFrame:
    made = arima_forecasts(split_panel(spark, folder), 1)
    return made.select("symbol", "seq", *[rounded(c, 2).alias(c) for c in ("linear_next", "linear_current", "linear_residual")])


@query(
    "g4_forecast_five_ahead",
    sql.samples(horizon=5) + _DIFFS + f""", fit AS (SELECT symbol, sum(d * d1) / sum(d1 * d1) AS phi FROM diffs WHERE split <> 'test' GROUP BY 1),
    scored AS (SELECT s.*, current_close + d * (phi + power(phi, 2) + power(phi, 3) + power(phi, 4) + power(phi, 5)) AS predicted
      FROM samples s JOIN diffs f ON f.symbol = s.symbol AND f.date = s.date JOIN fit ON fit.symbol = s.symbol WHERE s.split = 'test')
    SELECT {FORECAST} FROM scored""",
)
def g4_forecast_five_ahead(spark: SparkSession, folder: str) -> DataFrame:
    tests = samples(spark, folder, horizon=5).where("split = 'test'")
    return forecast_rows(attach_forecast(tests, arima_forecasts(split_panel(spark, folder), 5), "linear_next"))


@query("g5_moving_average_orders")
def g5_moving_average_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = ((2, 1, 2), (3, 1, 3))
    lagged = ar.lagged_panel(split_panel(spark, folder), orders)
    fitted = ar.fit_orders(lagged.where("split <> 'test'"), orders)
    return fitted.select("symbol", "order", *[rounded(F.col("phi")[i], 6).alias(f"w{i}") for i in range(ar.TERMS)])


_SELECTION = sql.split_panel() + _DIFFS + f""", one AS (SELECT symbol, sum(d * d1) / sum(d1 * d1) AS phi FROM diffs WHERE split = 'train' GROUP BY 1),
two AS {_TWO_LAGS.format("split = 'train'")},
led AS (SELECT *, lead(adjclose) OVER (PARTITION BY symbol, split ORDER BY date) AS target FROM diffs),
scored AS (SELECT l.symbol, 0 AS ordinal, '(1, 1, 0)' AS "order", target, adjclose + phi * d AS predicted FROM led l JOIN one USING (symbol) WHERE split = 'validation'
  UNION ALL SELECT l.symbol, 1, '(2, 1, 0)', target, adjclose + phi1 * d + phi2 * d1 FROM led l JOIN two USING (symbol) WHERE split = 'validation'),
scores AS (SELECT symbol, ordinal, "order", sqrt(avg((target - predicted) ** 2)) AS rmse FROM scored WHERE target IS NOT NULL GROUP BY 1, 2, 3),
log AS (SELECT *, coalesce(rmse < min(rmse) OVER (PARTITION BY symbol ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS selected,
  row_number() OVER (PARTITION BY symbol ORDER BY rmse, ordinal) = 1 AS best FROM scores)"""


@query("g6_order_selection", _SELECTION + f' SELECT symbol, ordinal, "order", {RND("rmse", 4)} AS rmse, selected, best FROM log')
def g6_order_selection(spark: SparkSession, folder: str) -> DataFrame:
    orders = ((1, 1, 0), (2, 1, 0))
    lagged = ar.lagged_panel(split_panel(spark, folder), orders)
    log = ar.select_order(lagged, orders, default=(1, 1, 0))
    return log.select("symbol", "ordinal", "order", rounded("rmse", 4).alias("rmse"), "selected", "best")


@query("g6_order_selection_full_grid")
def g6_order_selection_full_grid(spark: SparkSession, folder: str) -> DataFrame:
    log = ar.select_order(ar.lagged_panel(split_panel(spark, folder)))
    return log.select("symbol", "ordinal", "order", rounded("rmse", 4).alias("rmse"), "selected", "best")


@query("g6_arima_holdout")
def g6_arima_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Order chosen per symbol, refitted on train and validation, test rows forecast."""
    forecasted, _ = ar.holdout(split_panel(spark, folder))
    return forecast_rows(attach_forecast(samples(spark, folder).where("split = 'test'"), forecasted, "linear_next"))


@query(
    "g12_walk_forward_ar1",
    sql.samples() + _DIFFS + f""", running AS (SELECT symbol, date, d, sum(d * d1) OVER e / sum(d1 * d1) OVER e AS phi FROM diffs
      WINDOW e AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
    scored AS (SELECT s.*, current_close + phi * d AS predicted FROM samples s JOIN running r ON r.symbol = s.symbol AND r.date = s.date WHERE split = 'test')
    SELECT {FORECAST} FROM scored""",
)
def g12_walk_forward_ar1(spark: SparkSession, folder: str) -> DataFrame:
    made = ar.walk_forward(split_panel(spark, folder), 1)
    return forecast_rows(attach_forecast(samples(spark, folder).where("split = 'test'"), made, "linear_next"))


_AR3_DIFFS = """, ar3 AS (SELECT *, lag(d, 1) OVER w AS x1, lag(d, 2) OVER w AS x2, lag(d, 3) OVER w AS x3 FROM diffs WINDOW w AS (PARTITION BY symbol ORDER BY date))"""
_AR3_SUMS = ", ".join(
    [f"sum(x{i} * x{j}) OVER e AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if j >= i] + [f"sum(x{i} * d) OVER e AS b{i}" for i in (1, 2, 3)]
)


def _determinant(c1: str, c2: str, c3: str) -> str:
    """Of the 3 x 3 matrix with columns given by letters: ``a1`` is the first column of the sums, ``b`` the right-hand side."""

    def at(c: str, i: int) -> str:
        return f"b{i}" if c == "b" else f"a{min(i, int(c[1]))}{max(i, int(c[1]))}"

    rows = [[at(c, i) for c in (c1, c2, c3)] for i in (1, 2, 3)]
    (a, b, c), (d, e, f), (g, h, k) = rows
    return f"({a} * ({e} * {k} - {f} * {h}) - {b} * ({d} * {k} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


@query(
    "g12_walk_forward_ar3",
    sql.samples() + _DIFFS + _AR3_DIFFS + f""", running AS (SELECT symbol, date, d, x1, x2, {_AR3_SUMS} FROM ar3 WHERE x3 IS NOT NULL
      WINDOW e AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
    fitted AS (SELECT symbol, date, d, x1, x2, {_determinant('b', 'a2', 'a3')} / {_determinant('a1', 'a2', 'a3')} AS p1, {_determinant('a1', 'b', 'a3')} / {_determinant('a1', 'a2', 'a3')} AS p2,
      {_determinant('a1', 'a2', 'b')} / {_determinant('a1', 'a2', 'a3')} AS p3 FROM running),
    scored AS (SELECT s.*, current_close + p1 * d + p2 * x1 + p3 * x2 AS predicted FROM samples s JOIN fitted r ON r.symbol = s.symbol AND r.date = s.date WHERE split = 'test')
    SELECT {FORECAST} FROM scored""",
)
def g12_walk_forward_ar3(spark: SparkSession, folder: str) -> DataFrame:
    made = ar.walk_forward(split_panel(spark, folder), 3)
    return forecast_rows(attach_forecast(samples(spark, folder).where("split = 'test'"), made, "linear_next"))


@query("g12_walk_forward_selected_order")
def g12_walk_forward_selected_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order of least validation error of each symbol, moving averages included; both stages refitted at every step."""
    base = split_panel(spark, folder)
    made = two_stage.walk_forward_orders(base, two_stage.selected_orders(base))
    return forecast_rows(attach_forecast(samples(spark, folder).where("split = 'test'"), made, "linear_next"))


_EXPANDING_CHANGES = """, lags AS (SELECT symbol, date, seq, split, adjclose, d, lag(d, 1) OVER w AS x1, lag(d, 2) OVER w AS x2, lag(d, 3) OVER w AS x3 FROM diffs WINDOW w AS (PARTITION BY symbol ORDER BY date))"""
_INNOVATIONS = _EXPANDING_CHANGES + f""", sums AS (SELECT *,
      {', '.join(f"sum(CASE WHEN x2 IS NOT NULL THEN {a} * {b} END) OVER e AS {n}" for n, a, b in (("l11", "x1", "x1"), ("l12", "x1", "x2"), ("l22", "x2", "x2"), ("l1", "x1", "d"), ("l2", "x2", "d")))},
      {', '.join(f"sum(CASE WHEN x3 IS NOT NULL THEN {a} * {b} END) OVER e AS s{n}" for n, a, b in (("11", "x1", "x1"), ("12", "x1", "x2"), ("13", "x1", "x3"), ("22", "x2", "x2"), ("23", "x2", "x3"), ("33", "x3", "x3"), ("1", "x1", "d"), ("2", "x2", "d"), ("3", "x3", "d")))}
      FROM lags WINDOW e AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
    long AS (SELECT *, (l1 * l22 - l2 * l12) / (l11 * l22 - l12 * l12) AS b1, (l2 * l11 - l1 * l12) / (l11 * l22 - l12 * l12) AS b2 FROM sums),
    quads AS (SELECT *, s11 - b1 * s12 - b2 * s13 AS g12, s11 + b1 * b1 * s22 + b2 * b2 * s33 - 2 * b1 * s12 - 2 * b2 * s13 + 2 * b1 * b2 * s23 AS g22, s1 - b1 * s2 - b2 * s3 AS h2 FROM long),
    two AS (SELECT *, (s1 * g22 - h2 * g12) / (s11 * g22 - g12 * g12) AS phi, (h2 * s11 - s1 * g12) / (s11 * g22 - g12 * g12) AS theta FROM quads)"""


@query(
    "g12_walk_forward_moving_average",
    sql.samples() + _DIFFS + _INNOVATIONS + f""", scored AS (SELECT s.*, current_close + phi * d + theta * (d - b1 * x1 - b2 * x2) AS predicted
      FROM samples s JOIN two t ON t.symbol = s.symbol AND t.date = s.date WHERE s.split = 'test') SELECT {FORECAST} FROM scored""",
)
def g12_walk_forward_moving_average(spark: SparkSession, folder: str) -> DataFrame:
    """Order (1, 1, 1) with innovations of a two-term autoregression."""
    base = split_panel(spark, folder)
    made = two_stage.walk_forward_orders(base, two_stage.fixed_order(base, (1, 1, 1)), long_terms=2, deepest=3)
    return forecast_rows(attach_forecast(samples(spark, folder).where("split = 'test'"), made, "linear_next"))


# ---- volatility ------------------------------------------------------------------------------------

_RETURNS = """, returns AS (SELECT symbol, date, seq, r0, lag(r0) OVER w AS rb FROM (SELECT symbol, date, seq,
  100 * (ln(adjclose) - lag(ln(adjclose)) OVER (PARTITION BY symbol ORDER BY date)) AS r0 FROM split_panel) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
means AS (SELECT *, regr_slope(r0, rb) OVER e AS phi, regr_intercept(r0, rb) OVER e AS c FROM returns
  WINDOW e AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))"""


@query(
    "g7_return_mean_forecast",
    sql.samples() + _RETURNS + f""", scored AS (SELECT s.*, current_close * exp((c + phi * r0) / 100) AS predicted FROM samples s
    JOIN means m ON m.symbol = s.symbol AND m.date = s.date WHERE split = 'test') SELECT {FORECAST} FROM scored""",
)
def g7_return_mean_forecast(spark: SparkSession, folder: str) -> DataFrame:
    made = volatility.mean_forecast(split_panel(spark, folder))
    return forecast_rows(attach_forecast(samples(spark, folder).where("split = 'test'"), made, "predicted"))


_SHOCK, _FADE = 0.1, 0.75


@query(
    "g7_filtered_variance",
    "WITH RECURSIVE " + (sql.split_panel() + _RETURNS).removeprefix("WITH ") + f""", fits AS (SELECT *, CASE WHEN regr_count(r0, rb) OVER e >= 3 THEN c END AS c3, CASE WHEN regr_count(r0, rb) OVER e >= 3 THEN phi END AS phi3
      FROM means WINDOW e AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
    shocks AS (SELECT symbol, seq, (r0 - lag(c3) OVER w - lag(phi3) OVER w * rb) ** 2 AS s2 FROM fits WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    levels AS (SELECT *, CASE WHEN count(s2) OVER b >= 2 THEN avg(s2) OVER b END AS lv FROM shocks
      WINDOW b AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ready AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS i, lag(s2) OVER (PARTITION BY symbol ORDER BY seq) AS s1 FROM levels WHERE s2 IS NOT NULL AND lv IS NOT NULL),
    filtered AS (SELECT symbol, seq, i, lv AS h FROM ready WHERE i = 1
      UNION ALL SELECT r.symbol, r.seq, r.i, {1 - _SHOCK - _FADE} * r.lv + {_SHOCK} * r.s1 + {_FADE} * f.h FROM filtered f JOIN ready r ON r.symbol = f.symbol AND r.i = f.i + 1)
    SELECT symbol, seq, {RND('h', 4)} AS h FROM filtered""",
)
def g7_filtered_variance(spark: SparkSession, folder: str) -> DataFrame:
    """One shock lag and one variance lag with fixed weights, every row of every symbol."""
    shocks = volatility.shock_rows(split_panel(spark, folder))
    made = volatility.filtered_variance(shocks, weights=(_SHOCK, _FADE))
    return made.select("symbol", "seq", rounded("h", 4).alias("h"))


@query("g7_volatility_weighted_forecast")
def g7_volatility_weighted_forecast(spark: SparkSession, folder: str) -> DataFrame:
    made = volatility.forecasts(split_panel(spark, folder))
    return forecast_rows(attach_forecast(samples(spark, folder).where("split = 'test'"), made, "predicted"))


@query("g8_volatility_selection")
def g8_volatility_selection(spark: SparkSession, folder: str) -> DataFrame:
    log, _ = volatility.select_spec(split_panel(spark, folder))
    return log.select("symbol", "ordinal", "order", rounded("rmse", 4).alias("rmse"), "selected", "best")


# ---- windows as features ---------------------------------------------------------------------------

_WIDE = ["close", "feature_price_return_1"]
_SEQUENCE_WINDOW, _LONG_WINDOW = Settings().window_sizes


def _featured_samples(spark: SparkSession, folder: str) -> DataFrame:
    made = features.price_features(panel(spark, folder)).select("symbol", "seq", "feature_price_return_1")
    return samples(spark, folder).join(made, ["symbol", "seq"])


def _cast(df: DataFrame, digits: int = 2) -> DataFrame:
    return forecast_rows(df.withColumn("step", F.col("step").cast("long")), digits)


@query("g9_residual_hybrid")
def g9_residual_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _cast(sequence.residual_hybrid(split_panel(spark, folder), ["close", "volume"], _SEQUENCE_WINDOW))


@query("g10_window_regression")
def g10_window_regression(spark: SparkSession, folder: str) -> DataFrame:
    return _cast(sequence.holdout(_featured_samples(spark, folder), _WIDE, _SEQUENCE_WINDOW))


def _three_back(rows: str) -> str:
    """Tables over ``rows`` (symbol, date, split, v, y, ..): windows of three rows, their holdout fit and their expanding fit, by Cramer's rule."""
    frame = "PARTITION BY symbol ORDER BY date"
    sums = ", ".join([f"covar_pop(x{i}, x{j}) {{0}} AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if j >= i] + [f"covar_pop(x{i}, y) {{0}} AS b{i}, avg(x{i}) {{0}} AS m{i}" for i in (1, 2, 3)])
    full = _determinant("a1", "a2", "a3")
    slopes = f"{_determinant('b', 'a2', 'a3')} / {full} AS w1, {_determinant('a1', 'b', 'a3')} / {full} AS w2, {_determinant('a1', 'a2', 'b')} / {full} AS w3"
    guess = "my + w1 * (x1 - m1) + w2 * (x2 - m2) + w3 * (x3 - m3)"
    return f""", three AS (SELECT * FROM (SELECT *, lag(v, 2) OVER w AS x1, lag(v, 1) OVER w AS x2, v AS x3, count(*) OVER w3 AS n FROM {rows}
      WINDOW w AS ({frame}), w3 AS ({frame} ROWS 2 PRECEDING)) WHERE n = 3),
    held_sums AS (SELECT symbol, avg(y) AS my, {sums.format('')} FROM three WHERE split <> 'test' GROUP BY 1),
    held AS (SELECT symbol, my, m1, m2, m3, {slopes} FROM held_sums),
    held_out AS (SELECT t.*, {guess} AS guess FROM three t JOIN held USING (symbol) WHERE split = 'test'),
    walk_sums AS (SELECT *, avg(y) OVER e AS my, {sums.format('OVER e')} FROM three WINDOW e AS ({frame} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    walk AS (SELECT *, {slopes} FROM walk_sums WHERE split = 'test'),
    walked AS (SELECT *, {guess} AS guess FROM walk)"""


_CLOSES = sql.samples() + f""", lim AS (SELECT symbol, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi FROM samples WHERE split <> 'test' GROUP BY 1),
    rows3 AS (SELECT s.*, {sql.clip('close')} AS v, target AS y FROM samples s JOIN lim USING (symbol))""" + _three_back("rows3")


@query("g10_window_regression_three_back", _CLOSES + f", scored AS (SELECT *, guess AS predicted FROM held_out) SELECT {ROUGH} FROM scored")
def g10_window_regression_three_back(spark: SparkSession, folder: str) -> DataFrame:
    return _cast(sequence.holdout(samples(spark, folder), ["close"], 3), 1)


@query("g13_window_walk_forward_three_back", _CLOSES + f", scored AS (SELECT *, guess AS predicted FROM walked) SELECT {ROUGH} FROM scored")
def g13_window_walk_forward_three_back(spark: SparkSession, folder: str) -> DataFrame:
    return _cast(sequence.walk_forward(samples(spark, folder), ["close"], 3), 1)


_RESIDUALS = sql.split_panel() + _DIFFS + f""", ar AS (SELECT symbol, sum(d * d1) / sum(d1 * d1) AS phi FROM diffs WHERE split <> 'test' GROUP BY 1),
    res AS (SELECT f.symbol, date, seq, split, adjclose, d - phi * coalesce(d1, 0) AS r, adjclose + phi * d AS ahead FROM diffs f JOIN ar USING (symbol) WHERE d IS NOT NULL),
    sup AS (SELECT *, date AS feature_date, lead(date) OVER w AS target_date, lead(adjclose) OVER w AS target, lead(r) OVER w AS y,
      row_number() OVER w + CASE WHEN split = 'train' THEN 1 ELSE 0 END AS step FROM res WINDOW w AS (PARTITION BY symbol, split ORDER BY date)),
    lim AS (SELECT symbol, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM sup WHERE split <> 'test' AND target IS NOT NULL GROUP BY 1),
    rows3 AS (SELECT s.*, {sql.clip('r')} AS v FROM sup s JOIN lim USING (symbol) WHERE target IS NOT NULL)""" + _three_back("rows3")


@query("g9_residual_hybrid_three_back", _RESIDUALS + f", scored AS (SELECT *, ahead + guess AS predicted FROM held_out) SELECT {ROUGH} FROM scored")
def g9_residual_hybrid_three_back(spark: SparkSession, folder: str) -> DataFrame:
    """The residual alone, three rows back."""
    return _cast(sequence.residual_hybrid(split_panel(spark, folder), [], 3), 1)


@query("g10_window_regression_pooled")
def g10_window_regression_pooled(spark: SparkSession, folder: str) -> DataFrame:
    return _cast(sequence.pooled_holdout(_featured_samples(spark, folder), _WIDE, _SEQUENCE_WINDOW))


@query("g10_window_regression_long")
def g10_window_regression_long(spark: SparkSession, folder: str) -> DataFrame:
    return _cast(sequence.holdout(_featured_samples(spark, folder), _WIDE, _LONG_WINDOW))


@query("g13_window_walk_forward_long")
def g13_window_walk_forward_long(spark: SparkSession, folder: str) -> DataFrame:
    return _cast(sequence.walk_forward(_featured_samples(spark, folder), _WIDE, _LONG_WINDOW))


@query("g13_window_walk_forward")
def g13_window_walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    return _cast(sequence.walk_forward(_featured_samples(spark, folder), _WIDE, _SEQUENCE_WINDOW))


@query("g13_hybrid_walk_forward")
def g13_hybrid_walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    """The selected order of each symbol and a window of 20 residuals and closes; all stages refitted, all residuals renewed at every step."""
    base = split_panel(spark, folder)
    made = two_stage.walk_forward_hybrid(base, ["close"], WINDOW, two_stage.selected_orders(base))
    return _cast(attach_forecast(samples(spark, folder).where("split = 'test'"), made, "predicted"))


_MOVING = _EXPANDING_CHANGES + f""", ar AS (SELECT *, sum(d * x1) OVER e / sum(x1 * x1) OVER e AS phi FROM lags WINDOW e AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
    moments AS (SELECT *, {', '.join(f"avg({v}) OVER e AS m_{v}, " + ', '.join(f"covar_pop({v}, {w}) OVER e AS c_{v}_{w}" for w in ("d", "x1", "x2") if w >= v) for v in ("d", "x1", "x2"))}
      FROM ar WHERE x2 IS NOT NULL WINDOW e AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
    slopes AS (SELECT *, (c_d_x1 - phi * c_d_x2 - phi * c_x1_x1 + phi * phi * c_x1_x2) / (c_x1_x1 - 2 * phi * c_x1_x2 + phi * phi * c_x2_x2) AS w FROM moments)"""


@query(
    "g13_hybrid_walk_forward_one_back",
    sql.samples() + _DIFFS + _MOVING + f""", scored AS (SELECT s.*, current_close + phi * d + (m_d - phi * m_x1) + w * ((d - phi * x1) - (m_x1 - phi * m_x2)) AS predicted
      FROM samples s JOIN slopes t ON t.symbol = s.symbol AND t.date = s.date WHERE s.split = 'test') SELECT {FORECAST} FROM scored""",
)
def g13_hybrid_walk_forward_one_back(spark: SparkSession, folder: str) -> DataFrame:
    """Order (1, 1, 0) and the last residual alone, both by the coefficients of the step."""
    base = split_panel(spark, folder)
    made = two_stage.walk_forward_hybrid(base, [], 1, two_stage.fixed_order(base, (1, 1, 0)), deepest=1)
    return _cast(attach_forecast(samples(spark, folder).where("split = 'test'"), made, "predicted"))


# ---- grids -----------------------------------------------------------------------------------------


def experiment_grid(spark: SparkSession, settings: Settings) -> DataFrame:
    """Every horizon, window and model of the settings: a table as long as the settings say."""
    rows = [(h, w, m) for h in settings.prediction_horizons for w in settings.window_sizes for m in settings.selected_models]
    grid = spark.createDataFrame(rows, "horizon int, window int, model string")
    return grid.withColumn("experiment_key", experiment_key(F.lit(settings.price_column), F.col("horizon"), F.col("window")))


_MODEL_LIST = ", ".join(f"('{m}')" for m in MODELS)


@query(
    "g14_grid_sizes",
    sql.split_panel() + sql.sample_tables(1, "s1") + sql.sample_tables(5, "s5") + f""", counts AS (SELECT 1 AS horizon, split, count(*) AS rows FROM s1 GROUP BY 2
      UNION ALL SELECT 5, split, count(*) FROM s5 GROUP BY 2)
    SELECT horizon, "window", model, 'adjclose_h' || horizon || '_w' || "window" AS experiment_key, split, rows FROM counts,
      (VALUES (20), (60)) w("window"), (VALUES {_MODEL_LIST}) m(model)""",
)
def g14_grid_sizes(spark: SparkSession, folder: str) -> DataFrame:
    grid = experiment_grid(spark, Settings())
    counts = None
    for horizon in Settings().prediction_horizons:
        one = samples(spark, folder, horizon=horizon).groupBy("split").agg(F.count("*").alias("rows")).withColumn("horizon", F.lit(horizon))
        counts = one if counts is None else counts.unionByName(one)
    return grid.join(counts, "horizon").select("horizon", "window", "model", "experiment_key", "split", "rows")


@query(
    "g15_missing_runs",
    sql.predictions() + f""" SELECT 'adjclose_h' || h || '_w' || w AS experiment_key, m AS model FROM (VALUES (1), (5)) a(h), (VALUES (20), (60)) b(w), (VALUES {_MODEL_LIST}) c(m)
    WHERE ('adjclose_h' || h || '_w' || w, m) NOT IN (SELECT (experiment_key, model) FROM predictions)""",
)
def g15_missing_runs(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["experiment_key", "model"]
    return missing_runs(experiment_grid(spark, Settings()).select(*keys), predictions(spark, folder), keys)


@query("g15_resumed_run", sql.predictions() + " SELECT experiment_key, model, evaluation, count(*) AS rows, count(predicted) AS forecasts FROM predictions GROUP BY 1, 2, 3")
def g15_resumed_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run that ended after its first cell, taken up again."""
    root, cells = new_path(spark, "run"), prediction_cells(spark, folder)
    run_cells(spark, root, dict(list(cells.items())[:1]))
    made = run_cells(spark, root, cells)
    return made.groupBy("experiment_key", "model", "evaluation").agg(F.count("*").alias("rows"), F.count("predicted").alias("forecasts"))


@query(
    "g16_experiment_keys",
    sql.split_panel() + " SELECT symbol, 'adjclose_h' || count(*) || '_w' || min(seq) AS experiment_key FROM split_panel GROUP BY symbol",
)
def g16_experiment_keys(spark: SparkSession, folder: str) -> DataFrame:
    sizes = split_panel(spark, folder).groupBy("symbol").agg(F.count("*").alias("n"), F.min("seq").alias("m"))
    return sizes.select("symbol", experiment_key(F.lit("adjclose"), F.col("n"), F.col("m")).alias("experiment_key"))


# ---- flagship --------------------------------------------------------------------------------------

_METRIC_DIGITS = {"mae": 4, "mse": 0, "rmse": 4}


def metric_output(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, *[rounded(m, _METRIC_DIGITS.get(m, 6)).alias(m) if m != "direction_count" else F.col(m) for m in names])


def metric_output_sql(names: list[str]) -> str:
    return ", ".join(f"{RND(m, _METRIC_DIGITS.get(m, 6))} AS {m}" if m != "direction_count" else m for m in names)


_FLAGSHIP = ["mae", "rmse", "smape", "da", "direction_count", "up_f1", "down_f1"]


@query(
    "flagship_arima_backtest",
    sql.predictions("events", (1,)) + ", arima AS (SELECT * FROM predictions WHERE model = 'arima' AND evaluation = 'holdout')"
    + sql.metric_table("arima", "symbol, model, evaluation") + f" SELECT symbol, {metric_output_sql(_FLAGSHIP)} FROM metrics",
)
def flagship_arima_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks to bars, row rules, split, first-order fit, frozen one-step forecasts and metrics."""
    base = split_panel(spark, folder, "events")
    tests = samples(spark, folder, "events").where("split = 'test'")
    scored = attach_forecast(tests, arima_forecasts(base, 1), "linear_next")
    rows = prediction_rows(
        scored, first_test_dates(tests), model="arima", evaluation="holdout", feature_count=1, feature_set="adjclose", horizon=1, window=WINDOW
    )
    return metric_output(metrics(rows, ("symbol",)), ["symbol"], _FLAGSHIP)


@query("split_boundaries_text", sql.split_panel() + " SELECT CAST(train_end AS VARCHAR) AS train_end, CAST(validation_end AS VARCHAR) AS validation_end FROM ends")
def split_boundaries_text(spark: SparkSession, folder: str) -> DataFrame:
    ends = splits.boundary_dates(panel(spark, folder))
    return ends.select(F.col("train_end").cast("string").alias("train_end"), F.col("validation_end").cast("string").alias("validation_end"))
