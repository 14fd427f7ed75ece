import numpy as np
import pandas as pd
import pytest
from helpers import make_panel, to_spark
from pyspark.sql import functions as F

from panelcast.operators import splits


def days(n):
    return make_panel({"A": n})


@pytest.mark.parametrize(
    "n, train, validation, want", [(6, 0.5, 0.25, ("2024-01-03", "2024-01-04")), (10, 0.6, 0.2, ("2024-01-06", "2024-01-08")), (1, 0.7, 0.15, ("2024-01-01", "2024-01-01"))]
)
def test_calendar_boundaries(spark, n, train, validation, want):
    ends = splits.split_boundaries(to_spark(spark, days(n)), train, validation)
    assert (ends.train_end[:10], ends.validation_end[:10]) == want


def test_boundaries_come_from_all_symbols(spark):
    frame = pd.concat([make_panel({"A": 10}), make_panel({"B": 4})])
    ends = splits.split_boundaries(to_spark(spark, frame), 0.6, 0.2)
    assert ends.train_end[:10] == "2024-01-06"


def split_frame(spark, sizes, bounds):
    panel = to_spark(spark, make_panel(sizes))
    return panel.withColumn("split", splits.date_split(splits.Boundaries(*bounds)))


@pytest.mark.parametrize("horizon", [1, 5])
@pytest.mark.parametrize("rows", [3, 1000])
def test_no_label_crosses_a_split_and_positions_are_dense(spark, horizon, rows):
    base = split_frame(spark, {"A": 60, "B": 33, "C": 41}, ("2024-01-30 00:00:00", "2024-02-10 00:00:00"))
    made = splits.supervised_positions(splits.supervised(base, horizon, rows=rows), base, horizon).toPandas()
    ends = {"train": "2024-01-30", "validation": "2024-02-10", "test": "2030-01-01"}
    for split, end in ends.items():
        part = made[made["split"] == split]
        assert (part["target_date"] <= pd.Timestamp(end)).all()
    whole = base.toPandas().set_index(["symbol", "seq"])["adjclose"]
    for r in made.itertuples():
        assert r.target == whole[(r.symbol, r.seq + horizon)] and r.current_close == whole[(r.symbol, r.seq)]
    for _, part in made.sort_values("seq").groupby("symbol"):
        assert part["pos"].tolist() == list(range(1, len(part) + 1))
        for _, inner in part.groupby("split"):
            assert inner["step"].tolist() == list(range(1, len(inner) + 1))
    sizes = base.groupBy("symbol", "split").count().collect()
    assert len(made) == sum(max(r["count"] - horizon, 0) for r in sizes)


def test_ratio_split(spark):
    made = splits.ratio_split(to_spark(spark, make_panel({"A": 12, "B": 7})), 0.5, 0.25)
    got = {(r.symbol, r.split): r["count"] for r in made.groupBy("symbol", "split").count().collect()}
    assert got == {("A", "train"): 6, ("A", "validation"): 3, ("A", "test"): 3, ("B", "train"): 3, ("B", "validation"): 2, ("B", "test"): 2}


@pytest.mark.parametrize("rows", [2, 1000])
def test_windows_reach_back_over_split_gaps(spark, rows):
    base = split_frame(spark, {"A": 30, "B": 3}, ("2024-01-18 00:00:00", "2024-01-24 00:00:00"))
    samples = splits.supervised_positions(splits.supervised(base, 1), base, 1)
    made = splits.sliding_windows(samples, {"x": ["close", "volume"], "z": ["open"]}, 5, rows=rows).toPandas()
    table = samples.toPandas().sort_values(["symbol", "pos"])
    a = table[table["symbol"] == "A"].reset_index(drop=True)
    assert len(made) == len(a) - 4
    for r in made.itertuples():
        assert np.allclose(np.array(list(map(list, r.x))), a.loc[r.pos - 5 : r.pos - 1, ["close", "volume"]])
    counts = made.groupby("split").size()
    assert counts["validation"] == (a["split"] == "validation").sum() and counts["test"] == (a["split"] == "test").sum()


def test_extra_targets_and_refit(spark):
    base = split_frame(spark, {"A": 20}, ("2024-01-10 00:00:00", "2024-01-15 00:00:00"))
    made = splits.supervised(base, 1, extra={"next_volume": "volume"}).toPandas()
    volume = base.toPandas().set_index("seq")["volume"]
    assert all(r.next_volume == volume[r.seq + 1] for r in made.itertuples())
    merged = splits.merged_for_refit(base).groupBy("split").agg(F.count("*").alias("n")).collect()
    assert {r.split: r.n for r in merged} == {"train": 15, "test": 5}
