"""Each record once: repeated, killed and competing attempts, and a stream against the same rows as one table."""

import pytest

from sladd.operators.audit import audit_records
from sladd.plans.analyze import anonymize
from sladd.sources.ledger import BATCHES, Ledger, redact_once, redact_stream

ROWS = [(i, f"Kari {i}, tlf 9123456{i % 10}" if i % 3 else f"ingen {i}") for i in range(40)]


def redact(df):
    return anonymize(df, keep_spans=False)


def audit(df):
    return audit_records(df, doc="unit_id")


@pytest.fixture
def units(spark):
    return spark.createDataFrame(ROWS, "unit_id long, text string")


def seen(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_batches_come_whole_and_once(spark, units, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/out")
    assert ledger.read("redacted") is None
    assert redact_once(ledger, "a", units.where("unit_id < 25"), redact, audit)
    assert not redact_once(ledger, "a", units, redact, audit)
    assert redact_once(ledger, "b", units, redact, audit)
    assert seen(ledger.read("redacted"), "unit_id", "redacted") == seen(redact(units), "unit_id", "redacted")
    assert ledger.read("audit").count() == len(ROWS)
    assert {(r.batch, r["count"]) for r in ledger.read("inputs").groupBy("batch").count().collect()} == {("a", 25), ("b", 15)}


@pytest.mark.parametrize("name", ["", "a/b", "_x", ".x"])
def test_names(spark, units, tmp_path, name):
    with pytest.raises(ValueError):
        Ledger(spark, str(tmp_path)).commit(name, redacted=units)


def test_killed_before_the_rename(spark, units, tmp_path, monkeypatch):
    ledger = Ledger(spark, f"{tmp_path}/out")
    monkeypatch.setattr(Ledger, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        redact_once(ledger, "a", units, redact)
    assert ledger.read("redacted") is None
    monkeypatch.undo()
    assert redact_once(ledger, "a", units, redact)
    assert ledger.read("redacted").count() == len(ROWS)


def test_two_attempts_at_a_time(spark, units, tmp_path, monkeypatch):
    """The one that comes second finds the folder taken and leaves nothing of its own."""
    ledger, real = Ledger(spark, f"{tmp_path}/out"), Ledger.has
    assert ledger.commit("a", redacted=units)
    answers = iter([False])
    monkeypatch.setattr(Ledger, "has", lambda self, batch: next(answers, None) is not False and real(self, batch))
    assert not ledger.commit("a", redacted=units)
    assert ledger.read("redacted").count() == len(ROWS) and not list((tmp_path / "out" / "_staging").iterdir())


def test_failed_table_leaves_nothing(spark, units, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/out")
    with pytest.raises(Exception):
        ledger.commit("a", redacted=units, audit=units.selectExpr("raise_error('lost')"))
    assert not ledger.has("a") and ledger.read("redacted") is None


def test_stream_equals_table(spark, units, tmp_path):
    source, checkpoint = f"{tmp_path}/in", f"{tmp_path}/check"
    units.where("unit_id < 30").repartition(3).write.parquet(source)
    stream = lambda: spark.readStream.schema(units.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ledger, failures = Ledger(spark, f"{tmp_path}/out"), [2]

    def failing(df):
        if ledger.read("redacted") is not None and failures:
            failures.pop()
            raise RuntimeError("lost")
        return redact(df)

    with pytest.raises(Exception):
        redact_stream(stream(), ledger, checkpoint, failing, audit).awaitTermination()
    redact_stream(stream(), ledger, checkpoint, redact, audit).awaitTermination()
    units.where("unit_id >= 30").write.mode("append").parquet(source)
    redact_stream(stream(), ledger, checkpoint, redact, audit).awaitTermination()
    redact_stream(stream(), ledger, checkpoint, redact, audit).awaitTermination()
    assert len(list((tmp_path / "out" / BATCHES).iterdir())) >= 4
    assert seen(ledger.read("redacted"), "unit_id", "redacted", "n") == seen(redact(units), "unit_id", "redacted", "n")
    assert seen(ledger.read("audit"), "unit_id") == [(i,) for i, _ in ROWS]


def test_repeated_micro_batch(spark, units, tmp_path):
    """A micro-batch that was written but not noted in the checkpoint is repeated by Spark and taken once."""
    source, checkpoint = f"{tmp_path}/in", tmp_path / "check"
    units.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(units.schema).parquet(source)
    ledger = Ledger(spark, f"{tmp_path}/out")
    redact_stream(stream(), ledger, str(checkpoint), redact).awaitTermination()
    for note in (checkpoint / "commits").iterdir():
        note.unlink()
    redact_stream(stream(), ledger, str(checkpoint), redact).awaitTermination()
    assert ledger.read("redacted").count() == len(ROWS)
