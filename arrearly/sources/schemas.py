"""Canonical input schemas and the three vocabularies they come in."""

from __future__ import annotations

from pyspark.sql import types as T

_money = T.DecimalType(12, 2)
_pct = T.DecimalType(5, 2)
_score = T.DecimalType(5, 1)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


PORTFOLIO = _schema(
    account_id=T.LongType(),
    load_id=T.LongType(),
    load_ts=T.TimestampNTZType(),
    past_due=T.IntegerType(),
    balance=_money,
    birth_date=T.DateType(),
    saturation_pct=_pct,
    overdue_pct=_pct,
    reason_code=T.IntegerType(),
    last_contact_date=T.DateType(),
    punctuality=T.StringType(),
    model_efficiency=T.DecimalType(7, 2),
    income=_money,
)
THIRD_PARTY = _schema(
    customer_id=T.LongType(), load_ts=T.TimestampNTZType(), channel=T.StringType()
)
INTERACTIONS = _schema(
    account_id=T.LongType(),
    start_ts=T.TimestampNTZType(),
    kind=T.StringType(),
    outcome_code=T.IntegerType(),
    agent_id=T.LongType(),
    term_weeks=T.IntegerType(),
)
SCORES = _schema(
    customer_id=T.LongType(),
    cutoff_date=T.DateType(),
    contact_score=_score,
    agreement_score=_score,
    payment_score=_score,
    general_score=_score,
    payment_rank=T.IntegerType(),
)
PAYMENTS = _schema(
    customer_id=T.LongType(),
    payment_ts=T.TimestampNTZType(),
    amount=_money,
    payment_kind=T.StringType(),
)
EXPOSURE = _schema(
    customer_id=T.LongType(),
    overdue_balance=_money,
    base_fee=_money,
    current_balance=_money,
    snapshot_date=T.DateType(),
)

SCHEMAS = {
    "portfolio": PORTFOLIO,
    "third_party": THIRD_PARTY,
    "interactions": INTERACTIONS,
    "scores": SCORES,
    "payments": PAYMENTS,
    "exposure": EXPOSURE,
}

# --- Fixed values: source column name -> canonical name, per vocabulary ----
STAGING_NAMES = {
    "portfolio": {
        "customer_id": "account_id",
        "load_date": "load_ts",
        "days_past_due": "past_due",
        "outstanding_balance": "balance",
        "birth_date": "birth_date",
        "debt_saturation_pct": "saturation_pct",
        "non_payment_reason_code": "reason_code",
        "last_contact_date": "last_contact_date",
        "punctuality_score": "punctuality",
        "efficiency": "model_efficiency",
        "monthly_income": "income",
    },
    "third_party": {
        "external_customer_id": "customer_id",
        "load_date": "load_ts",
        "channel_type": "channel",
    },
    "interactions": {
        "customer_id": "account_id",
        "start_time": "start_ts",
        "interaction_type": "kind",
        "interaction_code": "outcome_code",
    },
    "scores": {"binary_payment_rank": "payment_rank"},
    "payments": {"payment_date": "payment_ts", "payment_type": "payment_kind"},
}
CORE_NAMES = {
    "portfolio": {
        "customer_id": "account_id",
        "assignment_date": "load_ts",
        "days_past_due": "past_due",
        "overdue_balance": "balance",
    },
    "third_party": {"assignment_date": "load_ts", "vendor_channel": "channel"},
    "interactions": {
        "customer_id": "account_id",
        "start_time": "start_ts",
        "movement_code": "kind",
        "movement_type": "outcome_code",
    },
    "payments": {"payment_date": "payment_ts", "payment_type": "payment_kind"},
    "exposure": {},
}
DIRECTORY_NAMES = {
    "portfolio": {
        "cliente": "account_id",
        "fechacarga": "load_ts",
        "moras": "past_due",
        "vencido": "balance",
        "fechanacimiento": "birth_date",
        "porcentvdo": "overdue_pct",
        "puntualidad": "punctuality",
        "eficiencia": "model_efficiency",
        "ingresomensual": "income",
    },
    "third_party": {
        "cliente_sindig": "customer_id",
        "fechacarga": "load_ts",
        "canal_cobranza": "channel",
    },
    "interactions": {
        "cliente": "account_id",
        "horainicio": "start_ts",
        "cvemovimiento": "kind",
        "tipomovimiento": "outcome_code",
    },
    "scores": {
        "idcte": "customer_id",
        "fechacorte": "cutoff_date",
        "score_contacto": "contact_score",
        "score_convenio": "agreement_score",
        "score_pago": "payment_score",
        "calif_pago_binario": "payment_rank",
    },
    "payments": {
        "idcte": "customer_id",
        "fecha": "payment_ts",
        "importe": "amount",
        "tipo_abono": "payment_kind",
    },
}
