from panelcast.operators import clean

RAW = "ingest_seq long, symbol string, date string, open double, high double, low double, close double, adjclose double, volume double"


def bar(i, symbol="A", date="2024-01-01", o=1.0, h=2.0, low=0.5, c=1.5, a=1.5, v=1.0):
    return (i, symbol, date, o, h, low, c, a, v)


def test_validity_rules(spark):
    good = [bar(1), bar(2, v=None), bar(3, a=None), bar(4, v=0.0)]
    bad = [
        bar(10, symbol=None), bar(11, date="x"), bar(12, o=None), bar(13, c=0.0), bar(14, low=-1.0),
        bar(15, h=0.4), bar(16, c=2.5), bar(17, a=0.4), bar(18, v=-1.0), bar(19, o=float("nan")), bar(20, h=float("inf")),
    ]
    kept = clean.keep_valid(clean.coerce_types(spark.createDataFrame(good + bad, RAW)))
    assert sorted(r.ingest_seq for r in kept.collect()) == [1, 2, 3, 4]


def test_blank_symbols_go_and_first_copy_stays_whatever_the_row_order(spark):
    rows = [bar(i, symbol=" A " if i % 2 else "A", o=1.0 + i / 100) for i in range(1, 40)] + [bar(99, symbol="  ")]
    for order in (rows, rows[::-1], rows[20:] + rows[:20]):
        made = clean.clean_panel(spark.createDataFrame(order, RAW).repartition(5)).collect()
        assert [(r.symbol, r.open) for r in made] == [("A", 1.01)]


def test_timestamp_parts_and_defaults(spark):
    rows = [("2024-02-01", None, None, None), (None, "2024", "2", "29"), (None, "2023", "2", "29"), (None, "x", "1", "1"), ("bad", "2024", "1", "2")]
    df = spark.createDataFrame(rows, "date string, year string, month string, day string")
    made = [str(r[0]) for r in df.select(clean.parse_timestamp(df)).collect()]
    assert made == ["2024-02-01 00:00:00", "2024-02-29 00:00:00", "None", "None", "2024-01-02 00:00:00"]


def test_calendar(spark):
    df = spark.sql("select timestamp_ntz'2024-02-29 13:45:00' as date union all select timestamp_ntz'2024-07-01 00:00:00'")
    a, b = clean.calendar_features(df).orderBy("date").collect()
    assert (a.feature_day_of_week, a.feature_is_month_start, a.feature_is_month_end, a.feature_hour, a.feature_minute) == (3, 0, 1, 13, 45)
    assert (b.feature_day_of_week, b.feature_is_month_start, b.feature_is_month_end) == (0, 1, 0)


def test_history_of_39_and_40_rows(spark):
    df = spark.range(79).selectExpr("if(id < 39, 'short', 'long') as symbol", "id")
    assert {r.symbol for r in clean.enough_history(df, 20, 1).select("symbol").distinct().collect()} == {"long"}
    assert clean.least_history(60, 5) == 70


def test_feature_gaps_become_zero_and_dates_stay(spark):
    df = spark.sql("select double('NaN') feature_a, cast(null as double) feature_b, 2.5D feature_c, cast(null as int) feature_d, date'2024-01-01' feature_date, double('inf') other")
    r = clean.zero_missing_features(df).first()
    assert (r.feature_a, r.feature_b, r.feature_c, r.feature_d, str(r.feature_date), r.other) == (0.0, 0.0, 2.5, 0, "2024-01-01", float("inf"))


def test_canonical_order(spark):
    df = spark.sql("select 1 extra, 2 volume, 3 symbol, 4 date, 5 open")
    assert clean.canonical_order(df).columns == ["date", "symbol", "open", "volume", "extra"]
