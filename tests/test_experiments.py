import pytest

from panelcast.plans.experiments import run_cells


def test_a_broken_run_resumes_to_the_rows_of_an_unbroken_one(spark, tmp_path):
    made = []

    def cell(name, n, broken=False):
        def build():
            made.append(name)
            if broken:
                raise RuntimeError(name)
            return spark.range(n).selectExpr("id", f"'{name}' AS cell")

        return build

    def rows(df):
        return sorted((r.cell, r.id) for r in df.collect())

    root = str(tmp_path / "run")
    # what a run that ended in the middle of a write left behind
    spark.range(99).selectExpr("id", "'b' AS cell").write.parquet(f"{root}/cell-b")
    with pytest.raises(RuntimeError):
        run_cells(spark, root, {"a": cell("a", 3), "b": cell("b", 2, broken=True), "c": cell("c", 1)})
    whole = {"a": cell("a", 3), "b": cell("b", 2), "c": cell("c", 1)}
    resumed = rows(run_cells(spark, root, whole))
    assert made == ["a", "b", "b", "c"]
    assert resumed == rows(run_cells(spark, str(tmp_path / "other"), whole)) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0)]
    made.clear()
    assert rows(run_cells(spark, root, whole)) == resumed and not made
