"""Times that arrive as text: parsed where they are well formed, else set aside with a reason."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrearly.sources.schemas import SCHEMAS

# The day's form, its length, and where year, month and day begin.
_DAYS = {
    "iso": (r"\d{4}-\d{2}-\d{2}", 10, (1, 6, 9)),
    "compact": (r"\d{8}", 8, (1, 5, 7)),
    "day_first": (r"\d{2}[/.-]\d{2}[/.-]\d{4}", 10, (7, 4, 1)),
    "month_first": (r"\d{2}[/.-]\d{2}[/.-]\d{4}", 10, (7, 1, 4)),
}
_CLOCK = r"(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?"
# A pattern's end may stand before one of these.
_LINE_ENDS = "\n\r\u0085\u2028\u2029"
STYLES = tuple(_DAYS)
# Why a row is set aside: the text has another form, or there is no such day or time.
FORM, VALUE = "form", "value"

REJECTED = "rejected"
_PARSED, _FAULTS, _TEXT, _TIME = "_parsed", "_faults", "_found_text", "_found_time"


@dataclass(frozen=True)
class Parsed:
    """``rows`` with times in place of texts, and the other rows as they came, with an array
    ``rejected`` of the columns at fault, as 'column: reason'."""

    rows: DataFrame
    rejected: DataFrame


def parsed_time(text: Column, style: str) -> tuple[Column, Column]:
    """The time that a text says, and the reason if it says none; both NULL for NULL.

    A time is a day and, if there is more, hours and minutes, and seconds with up to six
    digits. White space around it does not matter. It has no zone, so no hour is missing
    or there twice, whatever the zone of the session.
    """
    found = _well_formed(text, style)
    time = _time(found, style)
    return time, _reason(text, found, time)


def _well_formed(text: Column, style: str) -> Column:
    """The text without white space around it if it has the form of ``style``, else NULL."""
    if style not in _DAYS:
        raise ValueError(f"no style {style}; there are {', '.join(STYLES)}")
    text = F.btrim(text)
    return F.when(text.rlike(f"^{_DAYS[style][0]}{_CLOCK}$"), F.rtrim(text, F.lit(_LINE_ENDS)))


def _time(text: Column, style: str) -> Column:
    """The time of a well-formed text, in which every number has its place."""
    _, length, (year, month, of_month) = _DAYS[style]
    clock = F.concat(
        F.lit(" "), F.substring(text, length + 2, 5),
        F.when(F.length(text) == length + 6, ":00").otherwise(F.substring(text, length + 7, 10)),
    )
    iso = F.concat(
        F.substring(text, year, 4), F.lit("-"), F.substring(text, month, 2), F.lit("-"),
        F.substring(text, of_month, 2), F.when(F.length(text) == length, "").otherwise(clock),
    )
    return iso.try_cast("timestamp_ntz")


def _reason(text: Column, found: Column, time: Column) -> Column:
    return F.when(text.isNotNull() & time.isNull(), F.when(found.isNull(), FORM).otherwise(VALUE))


def text_times(df: DataFrame, table: str) -> list[str]:
    """The columns that should hold times or days and hold texts."""
    kinds = (T.DateType, T.TimestampNTZType, T.TimestampType)
    wanted = {f.name for f in SCHEMAS[table].fields if isinstance(f.dataType, kinds)}
    return [
        f.name for f in df.schema.fields if f.name in wanted and isinstance(f.dataType, T.StringType)
    ]


def parse_times(
    df: DataFrame, table: str, style: str | Mapping[str, str] = "iso"
) -> Parsed:
    """Split ``df`` (canonical names) by whether all its text times can be read.

    ``style`` is one of ``STYLES``, for all columns or per column. A day column takes the day
    of its text. Columns that hold times already stay as they are.
    """
    types = {f.name: f.dataType for f in SCHEMAS[table].fields}
    source = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    found, times, faults = {}, {}, []
    none = F.array().cast("array<string>")
    for i, name in enumerate(text_times(df, table)):
        of = style if isinstance(style, str) else style.get(name, "iso")
        text, time = f"{_TEXT}{i}", f"{_TIME}{i}"
        found[text] = _well_formed(F.col(name), of)
        times[time] = _time(F.col(text), of).cast(types[name])
        reason = _reason(F.col(name), F.col(text), F.col(time))
        fault = F.array(F.concat(F.lit(f"{name}: "), reason))
        faults.append(F.when(reason.isNull(), none).otherwise(fault))
    if not times:
        return Parsed(df, df.limit(0).withColumn(REJECTED, none))
    # One row made of each: filters on what is made stay above it, so a text is parsed once
    # however often its time is used. What is used more than once in it is made in a step below
    # and by functions that Spark compiles, which those with a lambda are not.
    steps = df.withColumns(found).withColumns(times)
    made = F.struct(F.concat(*faults).alias(_FAULTS), *times)
    parsed = steps.withColumn(_PARSED, made).select(*source, F.inline(F.array(_PARSED)))
    made = {n: F.col(f"{_TIME}{i}").alias(n) for i, n in enumerate(text_times(df, table))}
    others = [column for name, column in zip(df.columns, source) if name != REJECTED]
    return Parsed(
        parsed.where(F.size(_FAULTS) == 0).select(
            *(made.get(name, column) for name, column in zip(df.columns, source))
        ),
        parsed.where(F.size(_FAULTS) > 0).select(*others, F.col(_FAULTS).alias(REJECTED)),
    )


def rejected_counts(rejected: DataFrame) -> DataFrame:
    """(fault, rows): how many rows were set aside, by column and reason."""
    return (
        rejected.select(F.explode(REJECTED).alias("fault"))
        .groupBy("fault")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
