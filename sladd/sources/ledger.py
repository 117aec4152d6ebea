"""Sinks that hold each record once, also after a retry, and the redaction of a stream into them.

A batch is written to a staging folder of the attempt. When all of its tables are there, one rename makes them visible
together. A batch that is there already is never replaced, so a job that was killed can be repeated whole: what it had
committed is left out, what it had only staged is written anew. The rename must be atomic, as it is on HDFS and on POSIX file
systems; on an object store use a committer or table format that gives the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

BATCHES, STAGING = "batches", "_staging"


class Ledger:
    """Tables under ``out/batches/<batch>/<table>``; only whole batches are ever seen."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.out, *names)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, batch: str) -> bool:
        return self._files().exists(self._path(BATCHES, batch))

    def commit(self, batch: str, **tables: DataFrame) -> bool:
        """Write all tables of a batch, or none; False if the batch is there already, from another attempt too."""
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError(f"not a name for a batch: {batch!r}")
        if self.has(batch):
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.out}/{STAGING}/{attempt}/{name}")
        return self._publish(attempt, batch)

    def _publish(self, attempt: str, batch: str) -> bool:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs = jvm.org.apache.hadoop.fs
        self._files().mkdirs(self._path(BATCHES))
        # unlike FileSystem.rename, this one never moves into a folder that another attempt has put there
        context = fs.FileContext.getFileContext(self._files().getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(STAGING, attempt), self._path(BATCHES, batch), gateway.new_array(getattr(fs, "Options$Rename"), 0))
        except Exception:
            if not self.has(batch):
                raise
            self._files().delete(self._path(STAGING, attempt), True)
            return False
        return True

    def read(self, table: str) -> DataFrame | None:
        """The rows of all committed batches with the name of their ``batch``; None while there are none."""
        found = self._files().globStatus(self._path(BATCHES, "*", table))
        if not found:
            return None
        path = f"{self.out}/{BATCHES}/*/{table}"
        return self.spark.read.parquet(path).withColumn("batch", F.regexp_extract(F.input_file_name(), rf"/{BATCHES}/([^/]+)/", 1))

    def pending(self, inputs: DataFrame, key: str, table: str = "inputs") -> DataFrame:
        """Inputs whose ``key`` no committed batch has recorded."""
        done = self.read(table)
        return inputs if done is None else inputs.join(done.select(key).distinct(), key, "left_anti")


def redact_once(ledger: Ledger, batch: str, units: DataFrame, redact: Callable[[DataFrame], DataFrame],
                audit: Callable[[DataFrame], DataFrame] | None = None, key: str = "unit_id") -> bool:
    """Redacted units, their audit records and the list of inputs as one batch. Units that are done already are left out."""
    todo = ledger.pending(units, key)
    tables = {"redacted": redact(todo), "inputs": todo.select(key)}
    if audit is not None:
        tables["audit"] = audit(todo)
    return ledger.commit(batch, **tables)


def redact_stream(units: DataFrame, ledger: Ledger, checkpoint: str, redact: Callable[[DataFrame], DataFrame],
                  audit: Callable[[DataFrame], DataFrame] | None = None, **trigger):
    """Redact a streaming DataFrame into a ledger; returns the started query.

    A micro-batch is a batch of the ledger, named by the stream and its number. Spark repeats a micro-batch with the same rows
    after a failure, and the ledger then takes it once. ``trigger`` is that of ``writeStream``; by default all input that is there
    is taken, in several micro-batches, and the query ends.
    """

    def write(batch: DataFrame, number: int):
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("a micro-batch without the id of its stream")
        tables = {"redacted": redact(batch)}
        if audit is not None:
            tables["audit"] = audit(batch)
        ledger.commit(f"{stream}-{number:012d}", **tables)

    writer = units.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
