"""The pipeline's stages, one by one, and the registered queries."""

import corpus_pipeline
import duckdb
import pytest
from brute import similarity

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_license_scan", "op3_line_dedup", "op5_exact_dedup", "op6_jaccard_join", "op8_decontaminate", "op10_suffix_dedup",
                                  "op11_resample"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(map(tuple, result.fetchall()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    n, ids = docs.count(), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name == "token_ids":
            assert out.count() == docs.count() and out.filter("octet_length(ids) <> 4 * n_tokens").isEmpty()
            break
        assert out.columns == COLUMNS
        out = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r.doc_id for r in out.collect()}
        if name == "near_duplicates":
            classes = similarity([(r.doc_id, r.text) for r in docs.collect()])
            assert ids == {k for k, v in classes.items() if v[0] == k}
        else:
            assert len(ids) >= 0.97 * docs.count()
        docs = out
    assert len(ids) < n


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
