import duckdb
import pytest

import __spark_entry__ as driver
from panelcast.llm.queries import CHECKS, QUERIES
from test_queries import rows

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
COLUMNS = {
    "op4": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op9": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op10": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op11": dict.fromkeys(("doc_id", "n_runs", "start", "length", "period", "exponent_milli"), "bigint") | {"runs_sha256": "string", "collapsed_sha256": "string"},
    "op12": dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint") | {"groups_sha256": "string"},
    "op13": dict.fromkeys(("doc_id", "n_assign", "n_access", "n_hex"), "bigint") | {"base_sha256": "string", "spans": "string"},
}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_all_are_registered():
    names = [n.split("_")[0] for n in driver.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in driver.queries()
    assert set(CHECKS) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, sql, name):
    made, want = QUERIES[name](spark, FOLDER), sql.sql(CHECKS[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert rows(made.columns, made.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns(spark, name):
    kinds = dict(QUERIES[name](spark, FOLDER).dtypes)
    assert COLUMNS.get(name.split("_")[0], {}).items() <= kinds.items()
