"""Digests that stand for whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = (
    T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.DecimalType, T.DateType, T.TimestampNTZType,
)


def _text(field: T.StructField) -> Column | None:
    """A text that two values share only if DISTINCT takes them for the same."""
    value, kind = F.col(f"`{field.name}`"), type(field.dataType)
    if kind in (T.FloatType, T.DoubleType):
        return (value + F.lit(0.0)).cast("string")  # the two zeros are one value
    if kind is T.TimestampType:
        return F.unix_micros(value).cast("string")  # local times repeat in autumn
    if kind is T.BinaryType:
        return F.hex(value)
    return value.cast("string") if kind in _PLAIN else None


def row_digest(df: DataFrame) -> Column | None:
    """SHA-256 over all columns of a row, 32 bytes; None if a nested column has no
    text that tells its values apart.

    Every value stands with its length before it, and NULL is a mark of its own, so
    different rows have different texts.
    """
    parts = []
    for field in df.schema.fields:
        text = _text(field)
        if text is None:
            return None
        sized = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))
