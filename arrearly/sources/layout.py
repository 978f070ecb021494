"""The input tables laid out by month, so that an analysis reads its months only."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearly.functions.calendar import month_key
from arrearly.params import Settings
from arrearly.sources.schemas import SCHEMAS
from arrearly.sources.tables import Tables, read_tables

#: The partition column: 'YYYY-MM' of the time column.
MONTH_COLUMN = "load_month"
TIME_COLUMNS = {
    "portfolio": "load_ts",
    "third_party": "load_ts",
    "interactions": "start_ts",
    "scores": "cutoff_date",
    "payments": "payment_ts",
    "exposure": "snapshot_date",
}


def write_months(
    df: DataFrame, table: str, path: str, rows_per_file: int = 10_000_000
) -> None:
    """Write ``df`` (canonical columns) as Parquet with one folder per month.

    Months that ``df`` has rows of are replaced as a whole, others stay as they are, so
    loading a month again, or after a failure, gives the same table. Rows without a
    time make up a folder of their own, which no window reads.

    Rows are dealt by ranges of (month, key, time): a big month fills many tasks and a small
    one no file of its own per task, however the rows of one customer or month are
    spread; the sorted keys also give narrow ranges to the footers of the files.
    """
    time = TIME_COLUMNS[table]
    key = "account_id" if "account_id" in SCHEMAS[table].names else "customer_id"
    order = [MONTH_COLUMN, key, time]
    (
        df.withColumn(MONTH_COLUMN, month_key(time))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(MONTH_COLUMN)
        .parquet(path)
    )


def write_tables(tables: Tables, root: str, names: Iterable[str]) -> None:
    """The named tables below ``root``, each laid out by month.

    They are written at the same time: the last tasks of one table, and the few of a small one,
    leave cores free, which those of another take.
    """
    frames = {name: getattr(tables, name) for name in names}
    with ThreadPoolExecutor(max(len(frames), 1)) as pool:
        # A thread gets the properties of the caller's jobs, as their group, only so.
        written = [
            pool.submit(inheritable_thread_target(df.sparkSession)(write_months), df, n, f"{root}/{n}")
            for n, df in frames.items()
        ]
    for each in written:
        each.result()


def read_months(
    spark: SparkSession, root: str, settings: Settings, names: Iterable[str]
) -> Tables:
    """The named tables below ``root``, of each the months that ``settings`` need."""
    names = list(names)
    return read_tables(
        spark,
        {n: f"{root}/{n}" for n in names},
        month_columns=dict.fromkeys(names, MONTH_COLUMN),
        settings=settings,
    )
