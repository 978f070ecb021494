"""Reading the six input tables into the canonical schema."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrearly.params import DayWindow, Settings, score_window
from arrearly.sources.schemas import SCHEMAS
from arrearly.sources.times import parse_times


@dataclass(frozen=True)
class Tables:
    """The inputs of the analyses. An analysis that does not need a table
    leaves it unread, so it may be None."""

    portfolio: DataFrame
    third_party: DataFrame
    interactions: DataFrame | None = None
    scores: DataFrame | None = None
    payments: DataFrame | None = None
    exposure: DataFrame | None = None
    # What month partitions were read for, if not all.
    read_for: Settings | None = None
    # By table, the rows whose text times could not be read (see ``times``).
    rejected: Mapping[str, DataFrame] = field(default_factory=dict)

    def check(self, settings: Settings) -> None:
        """An error if the partitions that were read do not cover ``settings``: a
        narrower read would give a shorter history without a word."""
        if self.read_for is None:
            return
        window, asked = self.read_for.window, settings.window
        if asked.start < window.start or asked.end > window.end:
            raise ValueError(
                f"partitions were read for {window.start} to {window.end}, "
                f"the analysis asks for {asked.start} to {asked.end}"
            )
        if settings.score_lag_months > self.read_for.score_lag_months:
            raise ValueError("scores were read for a shorter lag than the analysis asks for")
        if self.exposure is not None and settings.exposure_date != self.read_for.exposure_date:
            raise ValueError("exposure was read for another day than the analysis asks for")


_INTEGERS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
_TIMES = (T.DateType(), T.TimestampType(), T.TimestampNTZType())
# Money may be wider than the canonical type: with up to 20 digits before the
# point, sums and counts of it still fit a decimal.
_WHOLE_DIGITS = 20


def _cast_to(found: T.DataType, wanted: T.DataType) -> T.DataType | None:
    """The type to read a column as, or None if a value could be lost."""
    if found == wanted:
        return found
    if found in _INTEGERS and wanted in _INTEGERS:
        return wanted if _INTEGERS.index(found) < _INTEGERS.index(wanted) else None
    if isinstance(found, T.DecimalType) and isinstance(wanted, T.DecimalType):
        whole = found.precision - found.scale
        if found.scale > wanted.scale or whole > _WHOLE_DIGITS:
            return None
        whole = max(whole, wanted.precision - wanted.scale)
        return T.DecimalType(whole + wanted.scale, wanted.scale)
    if found in _TIMES and wanted in _TIMES:
        # Of a date column only the day counts; instants may be of any kind.
        return wanted if wanted == T.DateType() else found
    return None


def conform(df: DataFrame, table: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """Rename to the canonical names and check every known column's type.

    Narrower integers and decimals are widened, timestamps for dates are cut to
    the day; a type that could lose values is an error. Unknown columns stay: a
    whole-row DISTINCT must see them, and Catalyst prunes them where nothing does.
    """
    df = df.withColumnsRenamed(dict(names or {}))
    wanted = {f.name: f.dataType for f in SCHEMAS[table].fields}
    wrong, casts = [], {}
    for field in df.schema.fields:
        if field.name not in wanted:
            continue
        target = _cast_to(field.dataType, wanted[field.name])
        if target is None:
            wrong.append(
                f"{field.name} is {field.dataType.simpleString()}, "
                f"not {wanted[field.name].simpleString()}"
            )
        elif target != field.dataType:
            casts[field.name] = F.col(field.name).cast(target)
    if wrong:
        raise TypeError(f"{table}: {'; '.join(wrong)}")
    return df.withColumns(casts) if casts else df


def require(df: DataFrame, table: str, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)}")
    return df


# The columns every vocabulary must supply for a table.
_KEYS = {
    "portfolio": ("account_id", "load_ts", "past_due"),
    "third_party": ("customer_id", "load_ts", "channel"),
    "interactions": ("account_id", "start_ts", "kind", "outcome_code"),
    "scores": ("customer_id", "cutoff_date"),
    "payments": ("customer_id", "payment_ts", "amount", "payment_kind"),
    "exposure": (
        "customer_id", "overdue_balance", "base_fee", "current_balance", "snapshot_date",
    ),
}


def prune_months(df: DataFrame, month_column: str, window: DayWindow) -> DataFrame:
    """Only the month partitions that ``window`` touches.

    ``month_column`` is the partition column of the storage layout: the first
    day of the month (date) or 'YYYY-MM' (string). A filter on the timestamp
    alone skips row groups, but lists and opens every file.
    """
    if df.schema[month_column].dataType == T.StringType():
        first, last = window.month_keys()[0], window.month_keys()[-1]
    else:
        first, last = window.start.replace(day=1), window.end
    return df.where(F.col(month_column).between(F.lit(first), F.lit(last)))


def read_tables(
    spark: SparkSession,
    locations: Mapping[str, str],
    names: Mapping[str, Mapping[str, str]] | None = None,
    month_columns: Mapping[str, str] | None = None,
    settings: Settings | None = None,
    time_styles: Mapping[str, str | Mapping[str, str]] | None = None,
) -> Tables:
    """Read the given tables: a location with a '/' is a Parquet path, any other
    one a catalog table. ``names`` is the vocabulary (see ``schemas``).

    For tables laid out by month, ``month_columns`` names their partition
    columns, and only the partitions that ``settings`` need are read: the months
    of the window, for scores those of the lag, for exposure that of its day. An
    analysis that needs others is refused. The partition column is dropped: it
    is not a part of the row for a whole-row DISTINCT.

    ``time_styles`` names the tables whose times are texts, with the style of these; rows
    with a text that is no time are not in the table but in ``rejected``.
    """
    windows = {}
    if settings is not None:
        windows = dict.fromkeys(locations, settings.window)
        windows["scores"] = score_window(settings.window, settings.score_lag_months)
        if settings.exposure_date is None:
            windows.pop("exposure", None)
        else:
            windows["exposure"] = DayWindow(settings.exposure_date, settings.exposure_date)
    pruned = False
    frames, rejected = {}, {}
    for table, location in locations.items():
        df = spark.read.parquet(location) if "/" in location else spark.table(location)
        month_column = (month_columns or {}).get(table)
        if month_column:
            if table in windows:
                df = prune_months(df, month_column, windows[table])
                pruned = True
            df = df.drop(month_column)
        df = df.withColumnsRenamed(dict((names or {}).get(table, {})))
        if table in (time_styles or {}):
            parsed = parse_times(df, table, time_styles[table])
            df, rejected[table] = parsed.rows, parsed.rejected
        df = conform(df, table)
        frames[table] = require(df, table, *_KEYS[table])
    return Tables(**frames, read_for=settings if pruned else None, rejected=rejected)
