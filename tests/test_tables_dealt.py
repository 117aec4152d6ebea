"""Tables whose rows lie in one row group among many splits."""

import pytest
from pyspark.sql import functions as F

from sladd.plans import queries


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(2000).select(
        F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), F.sha2(F.col("id").cast("string"), 256)).alias("c_name"),
        (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit(1.5).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield str(tmp_path)
    for k, v in old.items():
        spark.conf.set(k, v)


def fullest(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_one_row_group_is_dealt_out(spark, folder):
    """the splits beside the one with the row group are empty."""
    assert spark.read.parquet(f"{folder}/customer.parquet").rdd.getNumPartitions() > 3
    df = queries.table(spark, folder, "customer")
    assert df.count() == 2000 and fullest(df) <= 2000 // 4


@pytest.mark.parametrize("name", ["typed_table_redact"])
def test_analysis_is_dealt_out(spark, folder, name):
    """F3."""
    assert fullest(queries.REGISTRY[name][0](spark, folder)) <= 2000 // 4


def test_profile_is_dealt_out(spark, folder):
    """F4."""
    df = queries.column_profile(spark, folder)
    assert "RoundRobinPartitioning" in df._jdf.queryExecution().executedPlan().toString()
