from __future__ import annotations

import random
import sys
from datetime import date, datetime, time
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from arrearly import Tables  # noqa: E402
from arrearly.sources.schemas import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("recovery-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A canonical table from dicts; columns not given are NULL."""

    def make(table: str, *dicts: dict):
        schema = SCHEMAS[table]
        return spark.createDataFrame(
            [tuple(r.get(n) for n in schema.names) for r in dicts], schema
        )

    return make


def random_rows(seed: int, hot: bool) -> dict[str, list[dict]]:
    """Rows of the six tables with few ids and days, so that every key repeats,
    with NULLs wherever a column may hold them and intraday times. ``hot`` gives
    one customer a third of all rows."""
    rng = random.Random(seed)

    def customer(top=12):
        return 7 if hot and rng.random() < 1 / 3 else rng.randint(0, top)

    def account():
        return customer() * 10 + rng.randint(0, 2)

    def day():
        return date(1996, rng.choice([5, 6]), rng.randint(1, 30))

    def stamp():
        return datetime.combine(day(), time(rng.randint(0, 23)))

    def money(low, high):
        return Decimal(rng.randint(low, high)) / 100

    def maybe(value, share=0.15):
        return None if rng.random() < share else value

    interactions = [
        dict(
            account_id=maybe(account(), 0.03),
            start_ts=datetime.combine(day(), time(9)),
            kind=rng.choice("OOOF"),
            outcome_code=maybe(rng.choice([1, 2, 8, 33, 33, 35, 40])),
            agent_id=rng.randint(1, 2),
            term_weeks=maybe(rng.randint(0, 3)),
        )
        for _ in range(200)
    ]
    return {
        "portfolio": [
            dict(
                account_id=maybe(account(), 0.03),
                load_id=i,
                load_ts=stamp(),
                past_due=maybe(rng.randint(-1, 9)),
                balance=maybe(money(-10000, 100000), 0.05),
                birth_date=maybe(date(rng.randint(1930, 1978), 3, 1)),
                saturation_pct=maybe(money(0, 10000)),
                reason_code=maybe(rng.randint(1, 2)),
                last_contact_date=maybe(day()),
                punctuality=maybe(rng.choice("AB")),
                model_efficiency=maybe(money(0, 10000)),
                income=maybe(Decimal(rng.randint(0, 3)) * 1000),
            )
            for i in range(150)
        ],
        "third_party": [
            dict(
                customer_id=rng.randint(0, 14),
                load_ts=stamp(),
                channel=rng.choice(["1-URGENT", "2-HIGH", "5-LOW"]),
            )
            for _ in range(6)
        ],
        "interactions": interactions + interactions[:60],
        "scores": [
            dict(
                customer_id=customer(14),
                cutoff_date=date(1996, rng.choice([4, 5, 6]), 30),
                contact_score=maybe(Decimal(rng.randint(0, 200)) / 2),
                agreement_score=maybe(Decimal(rng.randint(0, 2))),
                payment_rank=maybe(rng.randint(1, 3)),
            )
            for _ in range(60)
        ],
        "payments": [
            dict(
                customer_id=maybe(customer(), 0.03),
                payment_ts=stamp(),
                amount=maybe(money(0, 20000), 0.05),
                payment_kind=rng.choice("NNA"),
            )
            for _ in range(200)
        ],
        "exposure": [
            dict(
                customer_id=c,
                overdue_balance=maybe(money(-500, 5000)),
                base_fee=Decimal(7),
                current_balance=maybe(money(0, 6000)),
                snapshot_date=day,
            )
            for c in [*range(0, 11), 3, 4]
            for day in (date(1996, 4, 30), date(1996, 5, 31))
        ],
    }


@pytest.fixture(scope="session")
def make_tables(spark):
    """The six tables from random rows."""

    def make(seed: int, hot: bool = False) -> Tables:
        return Tables(
            **{
                table: spark.createDataFrame(
                    [tuple(r.get(n) for n in SCHEMAS[table].names) for r in rows],
                    SCHEMAS[table],
                )
                for table, rows in random_rows(seed, hot).items()
            }
        )

    return make


@pytest.fixture
def random_tables(make_tables):
    return make_tables(1)
