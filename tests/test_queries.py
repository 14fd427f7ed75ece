"""Every named query with SQL text gives the same rows as that SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from panelcast.plans.catalogue import CHECKS, QUERIES

FOLDER = os.environ.get("PANELCAST_TEST_DATA", "/root/testdata/sf0.001")
TABLES = ("events", "lineitem", "part")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def generated_code(spark):
    """These checks run on generated code; the small brute-force tests run without it to save time."""
    settings = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([cell(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, sql, name):
    made = driver.queries()[name](spark, FOLDER)
    want = sql.sql(driver.oracle_sql()[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert rows(made.columns, made.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_other_queries_give_rows(spark, name):
    made = driver.queries()[name](spark, FOLDER).collect()
    assert made


def test_entry(spark):
    made = driver.entry(spark)
    assert made.count() == 5 and made.columns[0] == "symbol"
