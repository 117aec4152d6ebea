"""Extension points: detectors of one's own and spans of a model of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from sladd.functions.spans import SPAN_TYPE
from sladd.operators.aggregates import collect_spans
from sladd.rules.detectors import Detector, Pattern
from sladd.rules.entities import SCORE_THRESHOLD, SECONDARY_ENTITIES


def custom_detector(entity: str, patterns: Iterable[tuple], placeholder: str, context=(),
                    validator: str | None = None) -> Detector:
    """A detector from ``(regex, score)`` pairs. It is searched in the whole text."""
    table = tuple(Pattern(regex, float(score)) for regex, score in patterns)
    return Detector(entity.lower(), entity, table, tuple(context), validator, scope="text", placeholder=placeholder)


def usable(span, size: int) -> bool:
    """A span with offsets inside its text and a score."""
    _, start, end, score = span
    return start is not None and end is not None and score is not None and 0 <= start < end <= size


def with_model_spans(df: DataFrame, model: Callable[[pd.Series], Iterable], text: str = "text",
                     column: str = "external", primary: bool = False) -> DataFrame:
    """Add the spans a model finds, one list per text, as an array column.

    ``model`` gets a batch of texts and returns, per text, ``(entity, start, end, score)`` tuples. Rows stay
    where they are: batches stream through Arrow, nothing is shuffled or collected. Spans with missing offsets
    or offsets outside their text are left out. A model that is not ``primary`` may add persons and places only.
    """
    span = T.StructType([
        T.StructField("entity", T.StringType()), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
        T.StructField("src", T.IntegerType()),
    ])
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(span))])

    def run(batches):
        for batch in batches:
            found = model(batch[text])
            rows = [
                [{"entity": s[0], "start": int(s[1]), "end": int(s[2]), "score": float(s[3]), "src": int(not primary)}
                 for s in spans if usable(s, len(value or "")) and (primary or s[0] in SECONDARY_ENTITIES)]
                for value, spans in zip(batch[text], found)
            ]
            yield batch.assign(**{column: rows})

    return df.mapInPandas(run, schema)


def external_spans(rows: DataFrame, primary: int = 0) -> DataFrame:
    """Usable span rows of outside sources: above the threshold, and only persons and places from the others."""
    allowed = (F.col("src") == primary) | F.col("entity").isin(*SECONDARY_ENTITIES)
    return rows.where((F.col("score") >= SCORE_THRESHOLD) & allowed & (F.col("end") > F.col("start")))


def attach_spans(df: DataFrame, rows: DataFrame, unit: str, column: str = "external") -> DataFrame:
    """Join span rows to their units as an array column; units without spans get an empty array."""
    arrays = collect_spans(external_spans(rows), unit).withColumnRenamed("spans", column)
    empty = F.expr(f"cast(array() as array<{SPAN_TYPE}>)")
    return df.join(arrays, unit, "left").withColumn(column, F.coalesce(F.col(column), empty))
