"""Analyses over a multiple of the test data, with and without a hot customer.

    python benchmarks/hot_key.py SF_DIR COPIES [--hot] [--literal] [--conf name=value]

Writes ``COPIES`` copies of the six input tables, each with its own customers,
to a new scratch folder and times the analyses over them. ``--hot`` gives every
third copy to one single customer, i.e. a third of the rows of every table but
the third-party list, which would otherwise exclude that customer.
``--literal`` also times the plain join-then-aggregate form of two analyses
(with ``--hot`` only the first: the other one joins a customer's calls, payment
days and exposures with each other and does not end).
One JSON line: seconds per analysis, and the longest task of each, both of a
second, warm run.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import arrearly as a  # noqa: E402
from arrearly.functions import bands  # noqa: E402
from arrearly.operators.activity import promise_calls  # noqa: E402
from arrearly.operators.metrics import exposure_due  # noqa: E402
from arrearly.operators.payments import daily_payments, post_assignment_recovery  # noqa: E402
from arrearly.operators.portfolio import managed_accounts  # noqa: E402
from arrearly.operators.scores import scores_by_month  # noqa: E402
from arrearly.sources.schemas import SCHEMAS  # noqa: E402
from catalog.fixtures import FUNNEL, PIVOT, WHOLE, StarTables, copied, single_id  # noqa: E402

def literal_scores(t: a.Tables) -> DataFrame:
    """Every score row and payment day joined, then summed."""
    accounts = managed_accounts(t.portfolio, t.third_party, WHOLE)
    daily = daily_payments(t.payments, WHOLE.payment_kind, WHOLE.window)
    scored = accounts.join(
        scores_by_month(t.scores, WHOLE.window), ["customer_id", "month"], "left"
    )
    mesh = post_assignment_recovery(scored, daily)

    def by(label):
        return mesh.groupBy(label.alias("category")).agg(
            F.countDistinct("customer_id"), F.sum("balance"), F.sum("recovered_amount")
        )

    return by(bands.score_tier_label("payment_rank")).union(by(bands.bucket_label("risk_bucket")))


def literal_funnel(t: a.Tables) -> DataFrame:
    """Calls, payment days and exposure joined per customer, then counted."""
    accounts = managed_accounts(t.portfolio, t.third_party, FUNNEL, monthly=False, strip=False)
    code, customer = F.col("outcome_code"), F.col("customer_id")
    daily = daily_payments(t.payments, FUNNEL.payment_kind, FUNNEL.window).drop("month")
    return (
        accounts.join(
            promise_calls(t.interactions, FUNNEL.phone_kind, FUNNEL.window), "customer_id", "left"
        )
        .join(daily, "customer_id", "left")
        .join(
            exposure_due(t.exposure, FUNNEL.exposure_date).select("customer_id", "amount_due"),
            "customer_id",
            "left",
        )
        .groupBy("risk_bucket")
        .agg(
            F.countDistinct("customer_id"),
            F.countDistinct(F.when(code != FUNNEL.system_code, customer)),
            F.countDistinct(F.when(code.isin(*FUNNEL.rpc_codes), customer)),
            F.countDistinct(F.when(code.isin(*FUNNEL.agreement_codes), customer)),
            F.countDistinct(F.when(F.col("payment_date") >= F.col("record_date"), customer)),
            F.sum("amount_due"),
        )
    )


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("sf_dir")
    args.add_argument("copies", type=int)
    args.add_argument("--hot", action="store_true")
    args.add_argument("--literal", action="store_true")
    args.add_argument("--folder", default=None, help="where the tables go; a new one in it")
    args.add_argument("--conf", action="append", default=[], help="name=value")
    args = args.parse_args()
    scratch = tempfile.mkdtemp(prefix="run-", dir=args.folder)
    os.mkdir(f"{scratch}/events")
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("recovery-hot-key")
        .config("spark.sql.shuffle.partitions", "64")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", f"{scratch}/spark")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.compress", "false")
        .config("spark.eventLog.dir", f"{scratch}/events")
        .config(map=dict(c.split("=", 1) for c in args.conf))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    source = StarTables(spark, args.sf_dir)
    sizes = {}
    for table in SCHEMAS:
        hot = args.hot and table != "third_party"
        df = copied(getattr(source, table), args.copies, hot)
        df.repartition(32).write.parquet(f"{scratch}/{table}")
        sizes[table] = spark.read.parquet(f"{scratch}/{table}").count()
    t = a.read_tables(spark, {table: f"{scratch}/{table}" for table in SCHEMAS})
    analyses = {
        "p01a": lambda: a.assigned_by_month(t, PIVOT),
        "p01b": lambda: a.covered_customers(t, WHOLE),
        "p02": lambda: a.score_efficiency(t, WHOLE),
        "p03": lambda: a.demographic_efficiency(t, WHOLE),
        "p04": lambda: a.consolidated_efficiency(t, WHOLE),
        "p05": lambda: a.monthly_funnel(single_id(t), FUNNEL),
        "p06": lambda: a.agreements_by_month(t, PIVOT),
        "p07": lambda: a.predictive_efficiency(t, WHOLE),
        "kpis": lambda: a.kpis_by_month(t, WHOLE),
    }
    if args.literal:
        analyses["p02 literal"] = lambda: literal_scores(t)
        if not args.hot:
            analyses["p05 literal"] = lambda: literal_funnel(single_id(t))
    spans = {}
    for _ in ("cold", "warm"):
        for name, build in analyses.items():
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            spans[name] = (start, time.time())
    spark.stop()

    longest = {name: 0 for name in spans}
    for path in glob.glob(f"{scratch}/events/**", recursive=True):
        if not os.path.isfile(path):
            continue
        for line in open(path):
            event = json.loads(line)
            if event["Event"] != "SparkListenerTaskEnd":
                continue
            info = event["Task Info"]
            for name, (start, end) in spans.items():
                if start * 1000 <= info["Launch Time"] <= end * 1000:
                    took = info["Finish Time"] - info["Launch Time"]
                    longest[name] = max(longest[name], took)
    print(
        json.dumps(
            {
                "rows": sizes,
                "hot": args.hot,
                "seconds": {n: round(end - start, 1) for n, (start, end) in spans.items()},
                "longest_task": {n: round(ms / 1000, 1) for n, ms in longest.items()},
            }
        )
    )


if __name__ == "__main__":
    main()
