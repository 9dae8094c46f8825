"""Text expressions of built-in functions only, shared by the native operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of this package, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; null or empty text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1), "")


def lower_ascii(text: Column) -> Column:
    """A-Z only; ``lower`` does just that where a text has no other letters, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_blanks(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def inner_names(columns: Sequence[str], *wanted: str) -> list[str]:
    """Names of a table's columns while an operator works on it: those that it asks for
    (whatever their case), and ``own0``, ``own1``, ... for all others, so that nothing an
    operator makes can clash with a column of the caller's."""
    low = [c.lower() for c in columns]
    places = {low.index(w): w for w in wanted if w in low}
    return [places.get(k, f"own{k}") for k in range(len(columns))]


def finished(df: DataFrame, columns: Sequence[str], inner: Sequence[str], made: dict[str, Column] | None = None, **instead: Column) -> DataFrame:
    """The caller's columns under their own names, and ``made`` ones, which replace those of
    the same name in any case; ``instead`` gives new values by inner name. Two steps,
    since what a select names can be meant by the expressions behind it."""
    made = made or {}
    gone = {m.lower() for m in made}
    step = df.select(*(instead.get(i, F.col(i)).alias(i) for i in inner), *(v.alias(f"made{k}") for k, v in enumerate(made.values())))
    return step.select(*(F.col(i).alias(c) for i, c in zip(inner, columns, strict=True) if c.lower() not in gone),
        *(F.col(f"made{k}").alias(m) for k, m in enumerate(made)))
