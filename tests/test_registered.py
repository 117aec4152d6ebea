"""A few registered queries against their DuckDB texts; tools/check_oracles.py does all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = ("anonymize_documents", "det_national_id", "overlap_resolve", "name_list_join", "fp_salvage_prefix", "audit_records",
         "cell_header_join", "special_scan", "value_propagation", "context_boost")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    result = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == want and got


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["unit_id", "redacted", "n_email", "n_card", "n_ip"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
