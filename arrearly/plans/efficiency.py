"""Collection efficiency by score tier, bucket and segment mesh.

The published queries join accounts with score rows and payment days and sum
the balance over the result, so a balance counts once per score row and payment
day. That is the default. The ``net`` variants count each balance once, and each
customer's payments once, at the account with the first record date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearly.functions import bands
from arrearly.functions.rounding import mean
from arrearly.operators.keys import CUSTOMER_MONTH
from arrearly.operators.metrics import efficiency_mesh
from arrearly.operators.payments import (
    attach_portfolio_payments,
    daily_payments,
    monthly_payments,
    net_recovery,
    paid_once,
    recovery_by_account,
)
from arrearly.operators.portfolio import managed_accounts
from arrearly.operators.scores import (
    ROW_COUNT,
    attach_score_bands,
    attach_score_counts,
    latest_scores,
    score_counts,
    scores_by_month,
)
from arrearly.params import DIRECTORY, LAST_MONTH, STAGING, Settings
from arrearly.sources.tables import Tables

KEYS = ["account_id", *CUSTOMER_MONTH, "record_date"]
CONTACTABILITY = [
    bands.CONTACTABILITY_HIGH, bands.CONTACTABILITY_MEDIUM, bands.CONTACTABILITY_LOW,
]


def _daily(tables: Tables, settings: Settings) -> DataFrame:
    return daily_payments(
        tables.payments, settings.payment_kind, settings.window, settings.whole_last_day
    )


def _accounts(tables: Tables, settings: Settings, *used: str) -> DataFrame:
    tables.check(settings)
    return managed_accounts(
        tables.portfolio, tables.third_party, settings, used=("past_due", "balance", *used)
    )


def _scores(tables: Tables, settings: Settings) -> DataFrame:
    return scores_by_month(tables.scores, settings.window, settings.score_lag_months)


def _weighted(column: str) -> Column:
    """Once per score row and payment day, as the published joins repeat it."""
    return F.col(column) * F.col("mesh_rows")


def _per_score(column: str) -> Column:
    """Once per score row: the recovery of an account is the sum of its days."""
    return F.col(column) * F.col("score_rows")


def with_mesh_rows(mesh: DataFrame) -> DataFrame:
    """``mesh_rows``: how often the published joins repeat an account."""
    days = F.greatest(F.col("n_days"), F.lit(1)).cast("decimal(2,0)")
    return mesh.withColumn("mesh_rows", F.col("score_rows") * days)


def _once(mesh: DataFrame) -> DataFrame:
    one = F.lit(1).cast(ROW_COUNT)
    return mesh.withColumns({"score_rows": one, "mesh_rows": one})


def score_mesh(tables: Tables, settings: Settings, net: bool = False) -> DataFrame:
    """Accounts with payment rank, number of score and mesh rows and recovery.

    One row per account and payment rank: payment days are summed before the
    ranks are joined, so neither repeats the other.
    """
    accounts = _accounts(tables, settings).select(*KEYS, "risk_bucket", "balance")
    scores = _scores(tables, settings)
    if net:
        ranked = accounts.join(
            latest_scores(scores).select(*CUSTOMER_MONTH, "payment_rank"),
            CUSTOMER_MONTH,
            "left",
        )
        return _once(net_recovery(ranked, _daily(tables, settings)))
    recovered = recovery_by_account(accounts, _daily(tables, settings))
    return with_mesh_rows(attach_score_counts(recovered, score_counts(scores, "payment_rank")))


def score_efficiency(
    tables: Tables, settings: Settings = STAGING, net: bool = False
) -> DataFrame:
    """P02: efficiency by score tier, and by bucket, in one table.

    Both groupings are fed from one pass over the mesh: each row is labelled
    once for its tier and once for its bucket.
    """
    labels = F.array(
        F.struct(
            F.lit("By Predictive Score").alias("analysis_type"),
            bands.score_tier_label("payment_rank").alias("category"),
        ),
        F.struct(
            F.lit("By Risk Bucket").alias("analysis_type"),
            bands.bucket_label("risk_bucket").alias("category"),
        ),
    )
    labelled = score_mesh(tables, settings, net).select(
        F.inline(labels), "customer_id", "balance", "recovered_amount", "score_rows", "mesh_rows"
    )
    return efficiency_mesh(
        labelled,
        ["analysis_type", "category"],
        F.countDistinct("customer_id").alias("total_customers"),
        balance=_weighted("balance"),
        recovered=_per_score("recovered_amount"),
        efficiency="efficiency_percentage",
    ).orderBy(F.asc_nulls_last("analysis_type"), F.asc_nulls_last("category"))


def demographic_mesh(
    tables: Tables, settings: Settings = STAGING, net: bool = False
) -> DataFrame:
    """Accounts with age, saturation, recency and the payments of the month."""
    accounts = _accounts(
        tables, settings, "birth_date", "saturation_pct", "last_contact_date", "reason_code"
    ).withColumns(
        {
            "customer_age": bands.age_years("birth_date", "record_date"),
            "saturation_range": bands.saturation_range("saturation_pct"),
            "contact_recency_range": bands.contact_recency_range(
                "last_contact_date", "record_date"
            ),
            "non_payment_reason_code": bands.reason_or_zero("reason_code"),
        }
    ).withColumn("age_bracket", bands.age_bracket("customer_age"))
    monthly = monthly_payments(
        tables.payments, settings.payment_kind, settings.window, settings.whole_last_day
    )
    if net:
        paid = accounts.join(monthly, CUSTOMER_MONTH, "left").withColumn(
            "total_paid_amount", F.coalesce("paid_amount", F.lit(0))
        )
        return paid_once(paid, "total_paid_amount")
    return attach_portfolio_payments(accounts, monthly)


def demographic_efficiency(
    tables: Tables, settings: Settings = STAGING, net: bool = False
) -> DataFrame:
    """P03: efficiency by bucket, non-payment reason, age, saturation and recency.

    Payments of the whole month count, also those before the assignment. As
    published, ``total_customers`` counts accounts and payments repeat for every
    account of a customer; ``net=True`` counts customers, and a customer's payments
    of the month at its first account only.
    """
    customers = F.countDistinct("customer_id") if net else F.count(F.lit(1))
    return efficiency_mesh(
        demographic_mesh(tables, settings, net),
        [
            "risk_bucket",
            "non_payment_reason_code",
            "age_bracket",
            "saturation_range",
            "contact_recency_range",
        ],
        customers.alias("total_customers"),
        F.avg("customer_age").alias("avg_group_age"),
        recovered="total_paid_amount",
    ).orderBy(
        F.asc_nulls_last("risk_bucket"), F.asc_nulls_last("non_payment_reason_code")
    )


def consolidated_mesh(
    tables: Tables, settings: Settings = STAGING, net: bool = False
) -> DataFrame:
    """Accounts with age bracket, contactability and load tier, and recovery."""
    accounts = (
        _accounts(tables, settings, "birth_date", "income", "punctuality")
        .withColumns(
            {
                "age_bracket": bands.age_bracket(
                    bands.age_years("birth_date", "record_date")
                ),
                "financial_load_tier": bands.financial_load_tier("balance", "income"),
            }
        )
        .select(
            *KEYS, "risk_bucket", "balance", "punctuality", "income", "age_bracket",
            "financial_load_tier",
        )
    )
    scores = _scores(tables, settings)
    tier = bands.contactability_tier("contact_score")
    if net:
        one = latest_scores(scores).select(*CUSTOMER_MONTH, "contact_score")
        scored = (
            accounts.join(one, CUSTOMER_MONTH, "left")
            .withColumn("contactability_tier", tier)
            .drop("contact_score")
        )
        return _once(net_recovery(scored, _daily(tables, settings)))
    recovered = recovery_by_account(accounts, _daily(tables, settings))
    return with_mesh_rows(
        attach_score_bands(recovered, scores, tier, CONTACTABILITY, "contactability_tier")
    )


def consolidated_efficiency(
    tables: Tables, settings: Settings = STAGING, net: bool = False
) -> DataFrame:
    """P04: efficiency by bucket, punctuality, age, contactability and load."""
    mesh = consolidated_mesh(tables, settings, net).withColumnRenamed(
        "punctuality", "punctuality_score"
    )
    with_income = F.when(F.col("income").isNotNull(), F.col("mesh_rows"))
    return (
        efficiency_mesh(
            mesh,
            [
                "risk_bucket",
                "punctuality_score",
                "age_bracket",
                "contactability_tier",
                "financial_load_tier",
            ],
            F.countDistinct("customer_id").alias("total_customers"),
            F.sum(_weighted("income")).alias("income"),
            F.sum(with_income).alias("incomes"),
            balance=_weighted("balance"),
            recovered=_per_score("recovered_amount"),
        )
        .select(
            "risk_bucket",
            "punctuality_score",
            "age_bracket",
            "contactability_tier",
            "financial_load_tier",
            "total_customers",
            mean(F.col("income"), F.col("incomes"), 6).alias("avg_monthly_income"),
            "total_assigned_balance",
            "total_recovered_amount",
            "real_efficiency_pct",
        )
        .orderBy(
            F.asc_nulls_last("risk_bucket"),
            F.asc_nulls_last("age_bracket"),
            F.desc_nulls_first("real_efficiency_pct"),
        )
    )


def predictive_efficiency(
    tables: Tables,
    settings: Settings = DIRECTORY.during(LAST_MONTH),
    net: bool = False,
) -> DataFrame:
    """P07: model efficiency beside realized efficiency, by bucket and age.

    No score reaches the output, but as published a customer with several score
    rows counts that many times, so their number does.
    """
    accounts = (
        _accounts(tables, settings, "birth_date", "income", "model_efficiency")
        .withColumn(
            "rango_edad",
            bands.age_bracket(
                bands.age_years("birth_date", "record_date"), bands.AGE_BRACKETS_SHORT
            ),
        )
        .select(
            *KEYS, "risk_bucket", "rango_edad", "balance", "income", "model_efficiency"
        )
    )
    if net:
        mesh = _once(net_recovery(accounts, _daily(tables, settings)))
    else:
        recovered = recovery_by_account(accounts, _daily(tables, settings))
        mesh = with_mesh_rows(
            attach_score_counts(recovered, score_counts(_scores(tables, settings)))
        )

    def rows_with(column: str) -> Column:
        return F.sum(F.when(F.col(column).isNotNull(), F.col("mesh_rows")))

    return (
        efficiency_mesh(
            mesh.withColumnRenamed("risk_bucket", "bucket_mora"),
            ["bucket_mora", "rango_edad"],
            F.countDistinct("customer_id").alias("total_clientes"),
            F.sum(_weighted("income")).alias("income"),
            rows_with("income").alias("incomes"),
            F.sum(_weighted("model_efficiency")).alias("model"),
            rows_with("model_efficiency").alias("models"),
            balance=_weighted("balance"),
            recovered=_per_score("recovered_amount"),
            efficiency="eficiencia_real_pct",
        )
        .select(
            "bucket_mora",
            "rango_edad",
            "total_clientes",
            mean(F.col("income"), F.col("incomes"), 2).alias("ingreso_promedio"),
            mean(F.col("model"), F.col("models"), 2).alias("eficiencia_teorica_pct"),
            "eficiencia_real_pct",
        )
        .orderBy(F.asc_nulls_last("bucket_mora"), F.asc_nulls_last("rango_edad"))
    )
