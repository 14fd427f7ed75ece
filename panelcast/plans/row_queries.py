"""Queries over sources, row rules, ordered features and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.columns import finite, number, rounded
from panelcast.operators import clean, features, profile
from panelcast.operators.ordered import number_rows
from panelcast.plans import sql
from panelcast.plans.catalogue import query
from panelcast.plans.panels import SOURCES, full_panel, panel, prepare, prepare_dataset, samples, split_panel
from panelcast.sources import files, sinks
from panelcast.sources.shared import new_path

PRICES = ["open", "high", "low", "close", "adjclose"]
RND = sql.rnd


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Untyped bar rows from the event ticks, with regular defects of every kind."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    i = F.col("event_id")
    return e.select(
        i.alias("ingest_seq"),
        F.when(i % 113 == 0, F.lit(None)).when(i % 103 == 0, "   ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("symbol"),
        F.when(i % 107 == 0, "not a date").otherwise(F.date_trunc("hour", "ts").cast("timestamp_ntz").cast("string")).alias("date"),
        F.when(i % 109 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("open"),
        F.when(i % 101 == 0, F.col("value") * 0.5).otherwise(F.col("value") * 1.02).alias("high"),
        (F.col("value") * 0.98).alias("low"),
        F.when(i % 97 == 0, -F.col("value")).otherwise(F.col("value")).alias("close"),
        F.when(i % 7 != 0, F.col("value") * 1.01).alias("adjclose"),
        F.when(i % 83 == 0, F.lit(None)).when(i % 89 == 0, -5.0).otherwise(F.col("user_id").cast("double")).alias("volume"),
    )


# ---- sources and sinks -----------------------------------------------------------------------------

for _source in ("events", "lineitem"):
    query(f"a0_bars_{_source}", f"SELECT * FROM ({sql.BARS[_source]})")(
        lambda spark, folder, s=_source: SOURCES[s](spark, folder)
    )


def _bar_files(spark: SparkSession, folder: str) -> str:
    """Bars written as CSV trees with two different headers."""
    path = new_path(spark, "bar-files")
    bars = SOURCES["events"](spark, folder)
    few = bars.where("symbol < 'f'").withColumnRenamed("symbol", "ticker").withColumnRenamed("adjclose", "Adj Close")
    few.write.option("header", True).csv(f"{path}/first/deep")
    rest = bars.where("symbol >= 'f'").select(
        F.col("symbol").alias("Company"), F.year("date").alias("year"), F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"), F.hour("date").alias("hour"), "open", "high", "low",
        F.col("close").alias("Price"), F.col("volume").alias("Vol"),
    )
    rest.write.option("header", True).csv(f"{path}/second")
    return path


@query(
    "a1_read_bar_files",
    f"SELECT symbol, date, open, high, low, close, adjclose, volume FROM ({sql.BARS['events']}) WHERE open > 0 AND low > 0",
)
def a1_read_bar_files(spark: SparkSession, folder: str) -> DataFrame:
    raw, _ = files.read_bar_files(spark, _bar_files(spark, folder))
    return clean.clean_panel(raw).select("symbol", "date", *PRICES, "volume")


_HEADERS = {
    "one": {"date": "date", "symbol": "ticker", "open": "open", "high": "high", "low": "low", "close": "close", "adjclose": "Adj Close", "volume": "volume"},
    "two": {"symbol": "Company", "year": "year", "month": "month", "day": "day", "hour": "hour", "open": "open", "high": "high", "low": "low", "close": "Price", "volume": "Vol"},
}


@query(
    "a2_a3_inferred_headers",
    "WITH bars AS (" + sql.BARS["events"] + "), groups AS (SELECT DISTINCT symbol, CASE WHEN symbol < 'f' THEN 'one' ELSE 'two' END AS kind FROM bars) SELECT symbol AS file, logical, physical FROM groups JOIN (VALUES "
    + ", ".join(f"('{k}', '{logical}', '{physical}')" for k, m in _HEADERS.items() for logical, physical in m.items())
    + ") m(kind, logical, physical) USING (kind)",
)
def a2_a3_inferred_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file and logical column, for files of two layouts in one tree, one file per symbol."""
    path = new_path(spark, "bar-trees")
    bars = SOURCES["events"](spark, folder).withColumn("file", F.col("symbol"))
    few = bars.where("symbol < 'f'").withColumnRenamed("symbol", "ticker").withColumnRenamed("adjclose", "Adj Close")
    few.repartition("file").write.partitionBy("file").option("header", True).csv(f"{path}/deep/one")
    rest = bars.where("symbol >= 'f'").select(
        "file", F.col("symbol").alias("Company"), F.year("date").alias("year"), F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"), F.hour("date").alias("hour"), "open", "high", "low",
        F.col("close").alias("Price"), F.col("volume").alias("Vol"),
    )
    rest.repartition("file").write.partitionBy("file").option("header", True).csv(f"{path}/two")
    found = files.inferred_headers(spark, path)
    return found.select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("file"), "logical", "physical")


@query(
    "a4_symbol_from_file",
    "SELECT upper(event_type || ' x') AS symbol, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
)
def a4_symbol_from_file(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of real files without a symbol column, whose names hold a blank; the symbol comes from the name."""
    path = new_path(spark, "named-files")
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.concat("event_type", F.lit(" x")).alias("name"))
    events.repartition("name").write.partitionBy("name").parquet(path)
    raw = spark.read.parquet(path).select("event_id", files.plain_path(F.col("_metadata.file_path")).alias("path"))
    file = F.concat(F.regexp_extract("path", "name=([^/]+)/", 1), F.lit(".csv"))
    named = raw.select("event_id", files.symbol_from_file(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))).alias("symbol"))
    return named.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "a5_union_by_name",
    f"""SELECT symbol, date, open, volume, NULL::DOUBLE AS high FROM ({sql.BARS['events']})
    UNION ALL SELECT symbol, date, open, NULL, high FROM ({sql.BARS['lineitem']})""",
)
def a5_union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    a = SOURCES["events"](spark, folder).select("symbol", "date", "open", "volume")
    b = SOURCES["lineitem"](spark, folder).select("symbol", "date", "open", "high")
    return files.union_frames([a, b])


@query("a6_panel_sink", sql.panel() + " SELECT symbol, date, close, volume, seq FROM panel")
def a6_panel_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "panel-sink")
    sinks.write_panel(panel(spark, folder), path)
    return spark.read.parquet(path).select("symbol", "date", "close", "volume", "seq")


@query(
    "a8_reload_panel",
    sql.panel() + """ SELECT symbol, date, date AS feature_date, lead(date, 5) OVER (PARTITION BY symbol ORDER BY date) AS target_date,
    close FROM panel""",
)
def a8_reload_panel(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "panel-sink")
    sinks.write_panel(panel(spark, folder), path, months=False)
    reloaded = features.forward_targets(spark.read.parquet(path), 5)
    return reloaded.select("symbol", "date", "feature_date", "target_date", "close")


@query("a11_symbols", sql.panel() + " SELECT DISTINCT symbol FROM panel")
def a11_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return clean.symbols_of(panel(spark, folder))


@query("a11_symbols_allowed", sql.panel() + " SELECT DISTINCT symbol FROM panel WHERE symbol IN ('Brand#1', 'Brand#7', 'none')")
def a11_symbols_allowed(spark: SparkSession, folder: str) -> DataFrame:
    return clean.symbols_of(panel(spark, folder), ["Brand#1", "Brand#7", "none"])


# ---- row rules -------------------------------------------------------------------------------------


@query(
    "b1_timestamps",
    """WITH parts AS (SELECT *, CASE WHEN event_id % 107 = 0 THEN 13 ELSE month(ts) END AS m FROM events)
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 106 = 0 THEN NULL ELSE date_trunc('hour', ts) END
      ELSE TRY_CAST(year(ts) || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(day(ts)::VARCHAR, 2, '0') || ' ' || lpad(hour(ts)::VARCHAR, 2, '0') || ':00:00' AS TIMESTAMP) END AS date
    FROM parts""",
)
def b1_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/events.parquet")
    i, even = F.col("event_id"), F.col("event_id") % 2 == 0
    text = F.when(i % 106 == 0, "bad").otherwise(F.date_trunc("hour", "ts").cast("timestamp_ntz").cast("string"))
    mixed = e.select(
        "event_id",
        F.when(even, text).alias("date"),
        F.when(~even, F.year("ts")).alias("year"),
        F.when(~even, F.when(i % 107 == 0, 13).otherwise(F.month("ts"))).alias("month"),
        F.when(~even, F.dayofmonth("ts")).alias("day"),
        F.when(~even, F.hour("ts")).alias("hour"),
    )
    return mixed.select("event_id", clean.parse_timestamp(mixed).alias("date"))


@query("b2_numeric_coercion", sql.raw() + " SELECT ingest_seq, TRY_CAST(open AS DOUBLE) AS open, volume FROM raw")
def b2_numeric_coercion(spark: SparkSession, folder: str) -> DataFrame:
    return raw_rows(spark, folder).select("ingest_seq", number("open").alias("open"), number("volume").alias("volume"))


@query(
    "b3_b4_fill_optional",
    sql.raw() + " SELECT ingest_seq, adjclose, NULL::VARCHAR AS market, NULL::DOUBLE AS age, NULL::DOUBLE AS \"TARGET\" FROM typed",
)
def b3_b4_fill_optional(spark: SparkSession, folder: str) -> DataFrame:
    return clean.coerce_types(raw_rows(spark, folder)).select("ingest_seq", "adjclose", "market", "age", "TARGET")


@query("b5_valid_rows", sql.raw() + f" SELECT ingest_seq, symbol, date, open, high, low, close, adjclose, volume FROM typed WHERE {sql.VALID}")
def b5_valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    kept = clean.keep_valid(clean.coerce_types(raw_rows(spark, folder)))
    return kept.select("ingest_seq", "symbol", "date", *PRICES, "volume")


@query("b6_trimmed_symbols", sql.raw() + f" SELECT ingest_seq, trim(symbol) AS symbol FROM typed WHERE {sql.VALID} AND trim(symbol) <> ''")
def b6_trimmed_symbols(spark: SparkSession, folder: str) -> DataFrame:
    kept = clean.keep_valid(clean.coerce_types(raw_rows(spark, folder)))
    return clean.trim_symbol(kept).select("ingest_seq", "symbol")


CLEANED = sql.raw() + f""", kept AS (SELECT * REPLACE (trim(symbol) AS symbol) FROM typed WHERE {sql.VALID} AND trim(symbol) <> ''),
cleaned AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY ingest_seq) = 1)"""


@query("b7_first_copies", CLEANED + " SELECT symbol, date, open, high, low, close, adjclose, volume FROM cleaned")
def b7_first_copies(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_panel(raw_rows(spark, folder)).select("symbol", "date", *PRICES, "volume")


@query(
    "b8_time_parts",
    CLEANED + """ SELECT symbol, date, year(date)::INTEGER AS year, month(date)::INTEGER AS month, day(date)::INTEGER AS day,
    hour(date)::INTEGER AS hour, minute(date)::INTEGER AS minute FROM cleaned""",
)
def b8_time_parts(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean.clean_panel(raw_rows(spark, folder))
    return clean.time_parts(cleaned).select("symbol", "date", *clean.TIME_PARTS)


@query(
    "b9_calendar_features",
    sql.panel() + """ SELECT symbol, date, year(date)::INTEGER AS feature_year, month(date)::INTEGER AS feature_month,
    day(date)::INTEGER AS feature_day, (isodow(date) - 1)::INTEGER AS feature_day_of_week,
    (day(date) = 1)::INTEGER AS feature_is_month_start, (date::DATE = last_day(date))::INTEGER AS feature_is_month_end,
    hour(date)::INTEGER AS feature_hour, minute(date)::INTEGER AS feature_minute FROM panel""",
)
def b9_calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    made = clean.calendar_features(panel(spark, folder))
    return made.select("symbol", "date", *[c for c in made.columns if c.startswith("feature_")])


@query(
    "b10_canonical_order",
    sql.panel() + """ SELECT date, symbol, NULL::VARCHAR AS market, NULL::DOUBLE AS age, open, high, low, close, adjclose, volume,
    NULL::DOUBLE AS "TARGET", seq FROM panel""",
)
def b10_canonical_order(spark: SparkSession, folder: str) -> DataFrame:
    return clean.canonical_order(full_panel(spark, folder))


@query(
    "b11_enough_history",
    sql.panel() + " SELECT symbol, date, close FROM panel QUALIFY count(*) OVER (PARTITION BY symbol) >= greatest(40, 1440 + 5 + 5)",
)
def b11_enough_history(spark: SparkSession, folder: str) -> DataFrame:
    return clean.enough_history(panel(spark, folder), 1440, 5).select("symbol", "date", "close")


@query(
    "b12_finite_values",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events""",
)
def b12_finite_values(spark: SparkSession, folder: str) -> DataFrame:
    e, i = spark.read.parquet(f"{folder}/events.parquet"), F.col("event_id")
    broken = (
        F.when(i % 3 == 0, float("nan")).when(i % 5 == 0, float("inf")).when(i % 7 == 0, float("-inf")).otherwise(F.col("value"))
    )
    return e.select("event_id", finite(broken).alias("value"))


@query(
    "b13_zero_missing_features",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 0.0 ELSE value END AS feature_value,
    CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS other FROM events""",
)
def b13_zero_missing_features(spark: SparkSession, folder: str) -> DataFrame:
    e, i = spark.read.parquet(f"{folder}/events.parquet"), F.col("event_id")
    broken = F.when(i % 3 == 0, F.lit(None)).when(i % 5 == 0, float("-inf")).otherwise(F.col("value"))
    frame = e.select("event_id", broken.alias("feature_value"), F.when(i % 2 == 1, F.col("value")).alias("other"))
    return clean.zero_missing_features(frame)


# ---- ordered features ------------------------------------------------------------------------------

_DIGITS = {"feature_volume_return_1": 8}


def _feature_query(short: str, column: str) -> None:
    digits = 6
    gaps = ", CASE WHEN day(date) = 13 THEN NULL ELSE volume END AS gap_volume"
    base = sql.panel() + f", gapped AS (SELECT *{gaps} FROM panel)"
    text = base + sql.feature_table("gapped", "gap_volume") + f" SELECT symbol, date, {RND(column, digits)} AS {column} FROM featured"

    @query(f"{short}_{column.removeprefix('feature_')}", text)
    def build(spark: SparkSession, folder: str) -> DataFrame:
        gapped = panel(spark, folder).withColumn("volume", F.when(F.dayofmonth("date") != 13, F.col("volume")))
        made = features.price_features(gapped)
        return made.select("symbol", "date", rounded(column, digits).alias(column))


for _n, _column in enumerate(features.FEATURES, start=1):
    _feature_query(f"c{_n}", _column)


def _targets_query(horizon: int) -> None:
    text = sql.panel() + f""" SELECT symbol, date, date AS feature_date, lead(date, {horizon}) OVER w AS target_date,
    lead(close, {horizon}) OVER w AS target_next_close, lead(adjclose, {horizon}) OVER w AS target_next_adjclose
    FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)"""

    @query(f"c10_forward_targets_h{horizon}", text)
    def build(spark: SparkSession, folder: str) -> DataFrame:
        made = features.forward_targets(panel(spark, folder), horizon)
        return made.select("symbol", "date", "feature_date", "target_date", "target_next_close", "target_next_adjclose")


for _h in (1, 5):
    _targets_query(_h)


@query(
    "c11_percent_log_returns",
    sql.panel() + f""", r AS (SELECT symbol, date, 100 * (ln(adjclose) - lag(ln(adjclose)) OVER (PARTITION BY symbol ORDER BY date)) AS log_return FROM panel)
    SELECT symbol, date, {RND('log_return', 6)} AS log_return FROM r WHERE log_return IS NOT NULL""",
)
def c11_percent_log_returns(spark: SparkSession, folder: str) -> DataFrame:
    made = features.percent_log_returns(panel(spark, folder))
    return made.select("symbol", "date", rounded("log_return", 6).alias("log_return"))


_ALL = list(features.FEATURES)


@query("prepare_panel", sql.panel() + sql.feature_table() + f" SELECT symbol, date, seq, {sql.rounded_columns(_ALL, 6)} FROM featured")
def prepare_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The whole preparation from ticks to features, without any written panel of an earlier query."""
    made = features.price_features(prepare(spark, folder, "lineitem"))
    return made.select("symbol", "date", "seq", *[rounded(c, 6).alias(c) for c in _ALL])


@query(
    "numbered_rows",
    CLEANED + " SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS seq FROM cleaned",
)
def numbered_rows(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean.clean_panel(raw_rows(spark, folder)).select("symbol", "date")
    return number_rows(cleaned, ["symbol"], grain="day")


# ---- column profiles and groups --------------------------------------------------------------------

PROFILED = [
    "open", "high", "low", "close", "adjclose", "volume", "rsi_14", "current_close", "feature_range", "feature_copy",
    "flat", "sparse", "half", "future_close", "feature_month",
]


def profiled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Train rows with columns of every kind: constant, sparse, repeated, leaking, technical."""
    train = samples(spark, folder).where("split = 'train'")
    made = train.withColumns(
        {
            "rsi_14": F.col("close") * 2,
            "feature_range": F.col("high") - F.col("low"),
            "feature_copy": F.col("high") - F.col("low"),
            "flat": F.lit(1.0),
            "sparse": F.when(F.col("seq") % 10 < 3, F.col("open")),
            "half": F.when(F.col("seq") % 2 == 0, F.col("open")),
            "future_close": F.col("target") + 0.5,
            "feature_month": F.month("date"),
        }
    )
    return made.select("symbol", "date", "seq", "target", *PROFILED)


_PROFILE = sql.samples() + """, rows AS (SELECT symbol, seq, target, open, high, low, close, adjclose, volume, close * 2 AS rsi_14, current_close,
    high - low AS feature_range, high - low AS feature_copy, 1.0::DOUBLE AS flat, CASE WHEN seq % 10 < 3 THEN open END AS sparse,
    CASE WHEN seq % 2 = 0 THEN open END AS half, target + 0.5 AS future_close, month(date)::INTEGER AS feature_month
  FROM samples WHERE split = 'train'),
profile AS (""" + " UNION ALL ".join(
    f"SELECT symbol, {i}::INTEGER AS ordinal, '{c}' AS \"column\", avg(({c} IS NULL)::INTEGER) AS null_rate, count(DISTINCT {c}) <= 1 AS constant FROM rows GROUP BY symbol"
    for i, c in enumerate(PROFILED)
) + "), profiled AS (SELECT *, null_rate > 0.65 OR constant AS dropped FROM profile)"

_SAME_TYPE = [(a, b) for i, a in enumerate(PROFILED) for b in PROFILED[i + 1 :] if "feature_month" not in (a, b)]
_PAIRS = ", equal AS (SELECT symbol, " + ", ".join(
    f"bool_and({a} IS NOT DISTINCT FROM {b}) AS e{k}" for k, (a, b) in enumerate(_SAME_TYPE)
) + " FROM rows GROUP BY symbol), pairs AS (" + " UNION ALL ".join(
    f"SELECT symbol, '{b}' AS \"column\", '{a}' AS duplicate_of, {PROFILED.index(a)} AS k FROM equal WHERE e{n}" for n, (a, b) in enumerate(_SAME_TYPE)
) + """), usable AS (SELECT symbol, "column" FROM profiled WHERE NOT dropped),
repeated AS (SELECT p.symbol, p."column", arg_min(duplicate_of, k) AS duplicate_of FROM pairs p
  JOIN usable u ON u.symbol = p.symbol AND u."column" = p."column"
  JOIN usable v ON v.symbol = p.symbol AND v."column" = p.duplicate_of GROUP BY 1, 2)"""
_LEAK = "(lower(\"column\") IN ('target', 'feature_date', 'target_date') OR regexp_matches(lower(\"column\"), 'target|future|lead|label'))"


def _spots(names: tuple[str, ...]) -> str:
    return "list_position([" + ", ".join(f"'{n}'" for n in names) + "], c)::INTEGER"


_CATALOG = _PROFILE + _PAIRS + f""", kept AS (SELECT symbol, "column" AS c, ordinal FROM profiled WHERE NOT dropped AND NOT {_LEAK}
  AND (symbol, "column") NOT IN (SELECT (symbol, "column") FROM repeated)),
every AS (SELECT symbol, c, ordinal, true AS kept FROM kept UNION SELECT symbol, 'adjclose', 4, false FROM profiled
  WHERE (symbol, 'adjclose') NOT IN (SELECT (symbol, c) FROM kept)),
marked AS (SELECT *, kept AND c IN {profile.CALENDAR} AS calendar, c IN {profile.RAW} AS raw FROM every),
sorted AS (SELECT *, kept AND c LIKE 'feature\\_%' ESCAPE '\\' AND NOT calendar AS returns FROM marked),
grouped AS (SELECT *, kept AND NOT calendar AND NOT raw AND NOT returns
  AND (regexp_matches(lower(c), '{'|'.join(profile.TECHNICAL_TOKENS)}') OR c NOT LIKE 'feature\\_%' ESCAPE '\\') AS technical FROM sorted),
catalog AS (SELECT symbol, 'calendar_features' AS feature_group, {_spots(profile.CALENDAR)} AS ordinal, c AS "column" FROM grouped WHERE calendar
  UNION ALL SELECT symbol, 'raw_price_volume', {_spots(profile.RAW)}, c FROM grouped WHERE raw
  UNION ALL SELECT symbol, 'price_returns_volatility', ordinal, c FROM grouped WHERE returns
  UNION ALL SELECT symbol, 'provided_technical_indicators', ordinal, c FROM grouped WHERE technical
  UNION ALL SELECT symbol, 'price_technical_primary', CASE WHEN raw THEN {_spots(profile.RAW)} WHEN returns THEN 1000 + ordinal ELSE 100000 + ordinal END, c
    FROM grouped WHERE raw OR returns OR technical
  UNION ALL SELECT symbol, 'all_numeric_filtered', ordinal, c FROM grouped WHERE kept)"""


@query("d1_column_profile", _PROFILE + f' SELECT symbol, ordinal, "column", {RND("null_rate", 6)} AS null_rate, constant, dropped FROM profiled')
def d1_column_profile(spark: SparkSession, folder: str) -> DataFrame:
    made = profile.column_profile(profiled_rows(spark, folder), PROFILED)
    return made.withColumn("null_rate", rounded("null_rate", 6))


@query("d2_duplicate_columns", _PROFILE + _PAIRS + " SELECT * FROM repeated")
def d2_duplicate_columns(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_columns(profiled_rows(spark, folder), PROFILED)


@query("d3_leaking_columns", _PROFILE + f' SELECT symbol, "column", {_LEAK} AS leaks FROM profiled')
def d3_leaking_columns(spark: SparkSession, folder: str) -> DataFrame:
    made = profile.column_profile(profiled_rows(spark, folder), PROFILED)
    return made.select("symbol", "column", profile.leaks_expr(F.col("column")).alias("leaks"))


@query("d4_d5_feature_catalog", _CATALOG + " SELECT * FROM catalog")
def d4_d5_feature_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return profile.feature_catalog(profiled_rows(spark, folder))


@query("a7_profile_sink", _CATALOG + " SELECT * FROM catalog")
def a7_profile_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "profile-sink")
    catalog = profile.feature_catalog(profiled_rows(spark, folder))
    sinks.write_profile_json(catalog, path)
    return spark.read.schema(catalog.schema).json(path)


@query(
    "d5_configured_technical",
    _CATALOG + """ SELECT DISTINCT symbol, 'provided_technical_indicators' AS feature_group, 100000 AS ordinal, 'half' AS "column" FROM every""",
)
def d5_configured_technical(spark: SparkSession, folder: str) -> DataFrame:
    made = profile.feature_catalog(profiled_rows(spark, folder), configured_technical=["half", "absent"])
    return made.where("feature_group = 'provided_technical_indicators'")


@query(
    "d6_columns_for_model",
    _CATALOG + """ SELECT 'linear_regression' AS model, symbol, ordinal, "column" FROM catalog WHERE feature_group = 'raw_price_volume'
    UNION ALL SELECT 'lstm', symbol, ordinal, "column" FROM catalog WHERE feature_group = 'price_technical_primary'
    UNION ALL SELECT 'explicit', symbol, 0, 'close' FROM (SELECT DISTINCT symbol FROM catalog)""",
)
def d6_columns_for_model(spark: SparkSession, folder: str) -> DataFrame:
    catalog = profile.feature_catalog(profiled_rows(spark, folder))
    picked = [
        profile.columns_for_model(catalog, m).select(F.lit(m).alias("model"), "symbol", "ordinal", "column")
        for m in ("linear_regression", "lstm")
    ]
    explicit = profile.columns_for_model(catalog, "lstm", explicit=["close"])
    return files.union_frames([*picked, explicit.select(F.lit("explicit").alias("model"), "symbol", "ordinal", "column")])


@query("d7_columns_of_group", _CATALOG + """ SELECT symbol, ordinal, "column" FROM catalog WHERE feature_group = 'price_returns_volatility'""")
def d7_columns_of_group(spark: SparkSession, folder: str) -> DataFrame:
    return profile.columns_of_group(profile.feature_catalog(profiled_rows(spark, folder)), "price_returns_volatility")


@query(
    "d8_residual_model_columns",
    _CATALOG + """, listed AS (SELECT symbol, "column", min((CASE feature_group WHEN 'raw_price_volume' THEN 1 WHEN 'price_returns_volatility' THEN 2 ELSE 3 END) * 1000000 + ordinal) AS k
      FROM catalog WHERE feature_group IN ('raw_price_volume', 'price_returns_volatility', 'provided_technical_indicators') AND "column" <> 'half' GROUP BY 1, 2),
    chosen AS (SELECT DISTINCT symbol, 'linear_residual' AS "column", 0 AS k FROM catalog UNION ALL SELECT symbol, "column", k FROM listed)
    SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY k) - 1)::INTEGER AS ordinal, "column" FROM chosen""",
)
def d8_residual_model_columns(spark: SparkSession, folder: str) -> DataFrame:
    return profile.residual_model_columns(profile.feature_catalog(profiled_rows(spark, folder)), "linear_residual", ["half"])


_DATED = {
    "year": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "feature_year": "year", "feature_month": "month", "feature_day": "day",
}
_PREPARED = [
    "date", "feature_date", "target_date", "symbol", "market", "age", "year", "month", "day", "hour", "minute", "open", "high", "low", "close", "adjclose", "volume",
    "TARGET", "target_next_close", "target_next_adjclose",
    "feature_year", "feature_month", "feature_day", "feature_day_of_week", "feature_is_month_start", "feature_is_month_end", "feature_hour", "feature_minute",
    *features.FEATURES,
]
_MEASURED = [*PRICES, "volume", "target_next_close", "target_next_adjclose", *features.FEATURES]


@query(
    "prepared_dataset_from_files",
    sql.panel("events") + sql.feature_table() + f""", led AS (SELECT *, date AS feature_date, lead(date) OVER n AS target_date, lead(close) OVER n AS target_next_close,
      lead(adjclose) OVER n AS target_next_adjclose FROM featured WINDOW n AS (PARTITION BY symbol ORDER BY date))
    SELECT date, feature_date, target_date, symbol, NULL::VARCHAR AS market, NULL::DOUBLE AS age, NULL::DOUBLE AS "TARGET",
      {', '.join(f'{part}(date)::INTEGER AS {name}' for name, part in _DATED.items())}, hour(date)::INTEGER AS feature_hour, minute(date)::INTEGER AS feature_minute,
      (isodow(date) - 1)::INTEGER AS feature_day_of_week, (day(date) = 1)::INTEGER AS feature_is_month_start,
      (date::DATE = last_day(date))::INTEGER AS feature_is_month_end, {', '.join(f"{RND(c, 6)} AS {c}" for c in _MEASURED)} FROM led""",
)
def prepared_dataset_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """Bar files of two layouts to the prepared panel, written and loaded again, in canonical column order."""
    path = new_path(spark, "prepared")
    prepare_dataset(spark, _bar_files(spark, folder), path)
    made = files.read_panel(spark, f"{path}/panel")
    return made.select(*_PREPARED).withColumns({c: rounded(c, 6) for c in _MEASURED})


@query(
    "split_panel_rows",
    sql.split_panel() + " SELECT symbol, date, split FROM split_panel",
)
def split_panel_rows(spark: SparkSession, folder: str) -> DataFrame:
    return split_panel(spark, folder).select("symbol", "date", "split")
