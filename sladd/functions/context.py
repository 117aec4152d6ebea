"""Score boost for hits that follow a context word."""

from pyspark.sql import Column, functions as F

from sladd.functions.text import any_of, holds, let
from sladd.rules.entities import CONTEXT_BOOST, CONTEXT_FLOOR, CONTEXT_TOKENS

# Looking back this far is enough when it holds more than the tokens needed; else the whole prefix is used.
NEAR_CHARS = 256


def preceding_tokens(text: Column, start: Column, count: int = CONTEXT_TOKENS, cut=None) -> Column:
    """The last ``count`` lower-cased, space-separated tokens before ``start``, joined by newlines.

    ``cut(start, size)`` may replace plain substrings of ``text``.
    """
    cut = cut or (lambda at, size: F.substring(text, at + 1, size))

    def tokens(prefix):
        return F.filter(F.split(F.lower(prefix), r"(?U)\s+", -1), lambda t: t != "")

    near = cut(F.greatest(start - NEAR_CHARS, F.lit(0)), F.least(start, F.lit(NEAR_CHARS)))
    # The first token of a cut prefix may be partial, so one more than needed must be there.
    found = let(
        tokens(near),
        lambda t: F.when((start <= NEAR_CHARS) | (F.size(t) > count), t).otherwise(
            tokens(F.substring(text, F.lit(1), start))
        ),
    )
    return let(
        found, lambda t: F.array_join(F.slice(t, F.greatest(F.size(t) - count, F.lit(0)) + 1, F.lit(count)), "\n")
    )


def has_context(window: Column, words) -> Column:
    return holds(window, any_of(words)) if words else F.lit(False)


def boosted(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(score + CONTEXT_BOOST, F.lit(CONTEXT_FLOOR)))


def context_boost(text: Column, start: Column, score: Column, words) -> Column:
    return F.when(has_context(preceding_tokens(text, start), words), boosted(score)).otherwise(score)
