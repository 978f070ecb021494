"""The six input tables, derived from the star-schema test tables.

Every table is derived from whole source tables. Ids, bands and gaps come from
arithmetic on the keys, so that all branches of every rule occur; the same
expressions stand in ``oracle.py`` for DuckDB.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearly import DayWindow, Settings, Tables

# The whole span of the test data; 13 months of it for the month pivots; one
# month for the funnel.
SPAN = DayWindow(date(1995, 1, 1), date(2001, 12, 31))
YEAR = DayWindow(date(1996, 1, 1), date(1997, 1, 31))
MONTH = DayWindow(date(1996, 6, 1), date(1996, 6, 30))
EXPOSURE_DATE = date(1996, 5, 31)

WHOLE = Settings(
    window=SPAN,
    channels=("1-URGENT", "2-HIGH"),
    phone_kind="O",
    payment_kind="N",
    exposure_date=EXPOSURE_DATE,
)
PIVOT = WHOLE.during(YEAR)
FUNNEL = WHOLE.during(MONTH)


# Columns of the star tables that the mapping reads.
STAR_COLUMNS = {
    "customer": "c_custkey bigint, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, "
    "l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    customer = _table(spark, sf_dir, "customer")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .selectExpr(
            "o_custkey * 10 + o_orderkey % 3 AS account_id",
            "o_orderkey AS load_id",
            "o_orderdate + make_dt_interval(0, int(o_orderkey % 24)) AS load_ts",
            "int(o_orderkey % 10) AS past_due",
            "cast(o_totalprice AS decimal(12,2)) AS balance",
            """CASE WHEN o_custkey % 17 <> 0
                    THEN date_add(date'1930-01-01', int((o_custkey * 37) % 24000))
               END AS birth_date""",
            "cast(o_orderkey % 97 AS decimal(5,2)) AS saturation_pct",
            "cast(o_orderkey % 89 AS decimal(5,2)) AS overdue_pct",
            "int(nullif(o_orderkey % 6, 0)) AS reason_code",
            """CASE WHEN o_orderkey % 13 <> 0
                    THEN date_sub(o_orderdate, int(o_orderkey % 45))
               END AS last_contact_date""",
            "substr(c_mktsegment, 1, 1) AS punctuality",
            "cast(o_orderkey % 101 AS decimal(7,2)) AS model_efficiency",
            """CASE WHEN o_custkey % 11 = 0 THEN NULL
                    WHEN o_custkey % 13 = 0 THEN cast(0 AS decimal(12,2))
                    ELSE cast(abs(c_acctbal) * 30 AS decimal(12,2))
               END AS income""",
        )
    )


def third_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS customer_id",
        "o_orderdate + make_dt_interval(0, int(o_orderkey % 24)) AS load_ts",
        "o_orderpriority AS channel",
    )


def _lines_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn(
        "line_ts", F.expr("l_shipdate + make_dt_interval(0, l_linenumber * 3)")
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_with_customer(spark, sf_dir).selectExpr(
        "o_custkey AS customer_id",
        "line_ts AS payment_ts",
        "cast(l_extendedprice AS decimal(12,2)) AS amount",
        "l_returnflag AS payment_kind",
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines arrive twice: exact copies for the whole-row DISTINCT."""
    copies = "CASE WHEN l_returnflag = 'R' THEN array(1, 2) ELSE array(1) END"
    return (
        _lines_with_customer(spark, sf_dir)
        .selectExpr(
            "o_custkey * 10 + l_linenumber % 3 AS account_id",
            "line_ts AS start_ts",
            "l_linestatus AS kind",
            "int(nullif(l_partkey % 41, 40)) AS outcome_code",
            "l_suppkey AS agent_id",
            "nullif(int(l_quantity) % 6, 5) AS term_weeks",
            f"explode({copies}) AS copy",
        )
        .drop("copy")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pending order's score is cut off in the month after, so some
    customer-months have none."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS customer_id",
        """last_day(add_months(o_orderdate, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END))
           AS cutoff_date""",
        "cast(cast(o_orderkey % 201 AS decimal(5,1)) / 2 AS decimal(5,1)) AS contact_score",
        "cast(o_orderkey % 83 AS decimal(5,1)) AS agreement_score",
        "cast(o_orderkey % 79 AS decimal(5,1)) AS payment_score",
        "cast(o_orderkey % 73 AS decimal(5,1)) AS general_score",
        "int(o_orderkey % 12) AS payment_rank",
    )


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two month-end snapshots per customer; only one is the asked day."""
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS customer_id",
        "cast(c_acctbal AS decimal(12,2)) AS overdue_balance",
        "cast(100 + c_custkey % 50 AS decimal(12,2)) AS base_fee",
        """cast(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal
                     ELSE c_acctbal + c_custkey % 300 END AS decimal(12,2))
           AS current_balance""",
        "explode(array(date'1996-04-30', date'1996-05-31')) AS snapshot_date",
    )


class StarTables:
    """The input tables over one folder, each built when it is first used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._source = (spark, sf_dir)

    portfolio = cached_property(lambda self: portfolio(*self._source))
    third_party = cached_property(lambda self: third_party(*self._source))
    interactions = cached_property(lambda self: interactions(*self._source))
    scores = cached_property(lambda self: scores(*self._source))
    payments = cached_property(lambda self: payments(*self._source))
    exposure = cached_property(lambda self: exposure(*self._source))

    def check(self, settings: Settings) -> None:
        """Whole tables cover every window."""


def single_id(tables: Tables | StarTables) -> Tables:
    """Customer ids as account ids: the funnel's sources share one id space."""
    customer = F.expr("account_id div 10")
    return Tables(
        portfolio=tables.portfolio.withColumn("account_id", customer),
        third_party=tables.third_party,
        interactions=tables.interactions.withColumn("account_id", customer),
        payments=tables.payments,
        exposure=tables.exposure,
    )


def replace(tables: Tables | StarTables, **frames: DataFrame) -> Tables:
    """The same tables, some of them other ones."""
    names = Tables.__dataclass_fields__.keys() - {"read_for", "rejected"}
    return Tables(**{n: frames.get(n, getattr(tables, n)) for n in names})


HOT_CUSTOMER = 7


def copied(df: DataFrame, copies: int, hot: bool) -> DataFrame:
    """An input table ``copies`` times; copy c holds the customers c million and
    up. ``hot`` gives every third copy to one single customer."""
    key, unit = ("account_id", 10) if "account_id" in df.columns else ("customer_id", 1)
    every = F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))
    df = df.withColumn("copy", F.explode(every))
    shifted = F.col(key) + F.col("copy") * 1_000_000 * unit
    if hot:
        digit = F.col(key) % unit
        shifted = F.when(F.col("copy") % 3 == 0, HOT_CUSTOMER * unit + digit).otherwise(shifted)
    if "load_id" in df.columns:
        df = df.withColumn("load_id", F.col("load_id") + F.col("copy") * 100_000_000)
    return df.withColumn(key, shifted).drop("copy")
