"""Sinks: redacted copies and audit records under a run timestamp. Inputs are never touched."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F


def run_timestamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d_%H%M%S")


def scratch_folder(spark: SparkSession, base: str | None = None) -> str:
    """A fresh path in the folder given, else in ``spark.checkpoint.dir``, else in the warehouse.

    Executors must see it too, so a local warehouse will not do on a cluster.
    """
    shared = base or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        if shared.startswith(("/", "file:")) and not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/sladd-{uuid.uuid4().hex}"


def write_redacted(df: DataFrame, out: str, fmt: str = "parquet", run_ts: str | None = None) -> str:
    """Write under ``out/run_ts=<timestamp>`` and fail if it exists; returns the folder."""
    folder = f"{out}/run_ts={run_ts or run_timestamp()}"
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(folder)
    return folder


def audit_sink(records: DataFrame, out: str) -> None:
    """Append audit records as JSON lines, stamped in UTC, one folder per day."""
    now = datetime.now(timezone.utc)
    stamped = records.withColumn("timestamp", F.lit(now.isoformat())).withColumn("run_date", F.lit(now.date().isoformat()))
    stamped.write.mode("append").partitionBy("run_date").json(out)
