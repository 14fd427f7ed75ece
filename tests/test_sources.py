import pytest
from pyspark.sql import functions as F

from panelcast.operators.clean import clean_panel
from panelcast.sources.files import find_column, infer_header, inferred_headers, read_bar_files, read_panel, read_tables, symbol_from_file
from panelcast.sources.sinks import read_results, write_results

BARS = "date,ticker,open,high,low,close,adjclose,volume,RSIadjclose15,TARGET\n" + "".join(
    f"2024-01-0{i},AAA,{i},{i + 1},{i - 0.5},{i + 0.2},{i + 0.1},{9 + i},{10 * i},{(i - 1) / 10}\n" for i in range(1, 7)
)


def test_aliases_and_missing_columns():
    header = ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume", "Company"]
    found = infer_header(header).columns
    assert (found["symbol"], found["date"], found["adjclose"]) == ("Company", "Date", "Adj Close")
    assert find_column(["Date", "Close"], "volume") is None
    with pytest.raises(ValueError, match="volume"):
        infer_header(["Date", "Open", "High", "Low", "Close"])
    with pytest.raises(ValueError, match="no date"):
        infer_header(["Open", "High", "Low", "Close", "Volume", "year", "month"])


def test_equal_plain_names_take_the_last_column():
    assert find_column(["open-price", "Open_Price"], "open") == "Open_Price"
    assert find_column(["open_price", "OPEN"], "open") == "OPEN"


def test_reads_a_tree_with_several_headers(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.csv").write_text(BARS)
    (tmp_path / "zed.v2.csv").write_text(
        "year,month,day,Open,High,Low,Adj Close,Volume\n2024,2,30,1,2,0.5,1.5,3\n2024,2,3,1,2,0.5,1.5,3\n"
    )
    raw, maps = read_bar_files(spark, str(tmp_path))
    assert len(maps) == 2
    rows = clean_panel(raw).orderBy("symbol", "date").collect()
    assert [r["symbol"] for r in rows] == ["AAA"] * 6 + ["ZED.V2"]
    last = rows[-1]
    assert (last["close"], last["adjclose"], str(last["date"])) == (1.5, 1.5, "2024-02-03 00:00:00")
    assert [float(r["RSIadjclose15"]) for r in rows[:6]] == [10, 20, 30, 40, 50, 60]


def test_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_bar_files(spark, str(tmp_path))


def test_duplicates_across_files_keep_path_order(spark, tmp_path):
    line = "date,symbol,open,high,low,close,volume\n2024-01-01,A,{0},{0},{0},{0},1\n"
    for name, price in (("b.csv", 2), ("a.csv", 1), ("c.csv", 3)):
        (tmp_path / name).write_text(line.format(price))
    raw, _ = read_bar_files(spark, str(tmp_path))
    assert clean_panel(raw).first()["open"] == 1.0


def test_symbol_from_file(spark):
    df = spark.createDataFrame([("/a/b.c/msft.us.csv",), ("x.csv",), ("/d/.hidden",)], "p string")
    assert [r[0] for r in df.select(symbol_from_file(F.col("p"))).collect()] == ["MSFT.US", "X", ".HIDDEN"]


def test_results_round_trip_and_ragged_tables(spark, tmp_path):
    df = spark.createDataFrame([("k1", "m", 1.0), ("k2", "m", 2.0)], "experiment_key string, model string, rmse double")
    write_results(df.where("experiment_key = 'k1'"), str(tmp_path / "out"))
    write_results(df.where("experiment_key = 'k2'"), str(tmp_path / "out"))
    assert read_results(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "a.csv").write_text("x,date\n1,2024-01-01\n")
    (tmp_path / "b.csv").write_text("x,y\n2,3\n")
    made = read_tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["date"])
    assert dict(made.dtypes)["date"] == "timestamp_ntz"
    assert made.where("date is null and y = '3'").count() == 1


def test_files_with_differing_headers_in_one_tree(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a b.csv").write_text("model,rmse,symbol\narima,1.5,AAA\n")
    (tmp_path / "two.csv").write_text("symbol,model,epoch,rmse\nBBB,lin,3,2.5\n")
    (tmp_path / "combined.txt").write_text("symbol\nZZZ\n")
    (tmp_path / "empty.csv").write_text("")
    made = {tuple(r) for r in read_tables(spark, [str(tmp_path)], []).select("symbol", "model", "rmse", "epoch").collect()}
    assert made == {("AAA", "arima", "1.5", None), ("BBB", "lin", "2.5", "3")}


def test_symbol_from_a_file_name_with_blanks(spark, tmp_path):
    for name in ("brk b.csv", "x+y.csv"):
        (tmp_path / name).write_text("date,open,high,low,close,volume\n2024-01-01,1,1,1,1,1\n")
    raw, _ = read_bar_files(spark, str(tmp_path))
    assert sorted(r.symbol for r in raw.select("symbol").collect()) == ["BRK B", "X+Y"]


def test_headers_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Ticker","Open-Price",Open_Price,date\n')
    made = {(r.logical, r.physical) for r in inferred_headers(spark, str(tmp_path)).collect()}
    assert made == {("symbol", "Ticker"), ("open", "Open_Price"), ("date", "date")}


def test_a_rerun_replaces_its_results(spark, tmp_path):
    df = spark.createDataFrame([("k1", "m", 1.0), ("k2", "m", 2.0)], "experiment_key string, model string, rmse double")
    for _ in range(2):
        write_results(df.where("experiment_key = 'k1'"), str(tmp_path / "out"))
        write_results(df.where("experiment_key = 'k2'"), str(tmp_path / "out"))
    assert read_results(spark, str(tmp_path / "out")).count() == 2


def test_reloaded_panel(spark, tmp_path):
    rows = [("A", f"2024-01-0{i}", str(i), str(i + 1)) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "symbol string, date string, close string, adjclose string")
    df.write.option("header", True).csv(str(tmp_path / "panel.csv"))
    made = read_panel(spark, str(tmp_path / "panel.csv")).orderBy("date").collect()
    assert [(str(r.target_date)[:10], r.target_next_close, r.seq) for r in made[:3]] == [(f"2024-01-0{i}", float(i), i - 1) for i in (2, 3, 4)]
    done = spark.createDataFrame([("A", "2024-01-01", "2024-01-01", "2024-01-09", 1)], "symbol string, date string, feature_date string, target_date string, seq long")
    done.write.parquet(str(tmp_path / "done"))
    assert str(read_panel(spark, str(tmp_path / "done")).first().target_date)[:10] == "2024-01-09"
