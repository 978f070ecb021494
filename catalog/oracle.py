"""DuckDB SQL for every query, written as the plain joins the operators avoid.

A query is the list of common table expressions it needs plus a SELECT. Where
the Spark side carries counts (score rows, accounts per customer, calls per
customer), the SQL here joins the rows themselves.
"""

from __future__ import annotations

from datetime import date

from arrearly.functions import bands as b
from arrearly.params import AGREEMENT_CODES, RPC_CODES, DayWindow, spanish_month_label
from catalog.fixtures import EXPOSURE_DATE, FUNNEL, SPAN, WHOLE, YEAR

ORACLE_SQL: dict[str, str] = {}
_PARTS: dict[str, tuple[str, str, dict[str, str]]] = {}


# --- the six input tables --------------------------------------------------------

_LINES = """
    SELECT l.*, o.o_custkey, l.l_shipdate + to_hours(l.l_linenumber * 3) AS line_ts
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
"""

INPUTS = {
    "portfolio": """
        SELECT o_custkey * 10 + o_orderkey % 3 AS account_id,
               o_orderkey AS load_id,
               o_orderdate + to_hours(o_orderkey % 24) AS load_ts,
               CAST(o_orderkey % 10 AS INTEGER) AS past_due,
               CAST(o_totalprice AS DECIMAL(12,2)) AS balance,
               CASE WHEN o_custkey % 17 <> 0
                    THEN DATE '1930-01-01' + CAST((o_custkey * 37) % 24000 AS INTEGER)
               END AS birth_date,
               CAST(o_orderkey % 97 AS DECIMAL(5,2)) AS saturation_pct,
               CAST(nullif(o_orderkey % 6, 0) AS INTEGER) AS reason_code,
               CASE WHEN o_orderkey % 13 <> 0
                    THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 45 AS INTEGER)
               END AS last_contact_date,
               substr(c_mktsegment, 1, 1) AS punctuality,
               CAST(o_orderkey % 101 AS DECIMAL(7,2)) AS model_efficiency,
               CASE WHEN o_custkey % 11 = 0 THEN NULL
                    WHEN o_custkey % 13 = 0 THEN CAST(0 AS DECIMAL(12,2))
                    ELSE CAST(abs(c_acctbal) * 30 AS DECIMAL(12,2)) END AS income
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "third_party": """
        SELECT o_custkey AS customer_id,
               o_orderdate + to_hours(o_orderkey % 24) AS load_ts,
               o_orderpriority AS channel
        FROM orders""",
    "payments": f"""
        SELECT o_custkey AS customer_id, line_ts AS payment_ts,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
               l_returnflag AS payment_kind
        FROM ({_LINES})""",
    "interactions": f"""
        SELECT * EXCLUDE (copy) FROM (
        SELECT o_custkey * 10 + l_linenumber % 3 AS account_id,
               line_ts AS start_ts,
               l_linestatus AS kind,
               CAST(nullif(l_partkey % 41, 40) AS INTEGER) AS outcome_code,
               l_suppkey AS agent_id,
               nullif(CAST(l_quantity AS INTEGER) % 6, 5) AS term_weeks,
               unnest(CASE WHEN l_returnflag = 'R' THEN [1, 2] ELSE [1] END) AS copy
        FROM ({_LINES}))""",
    "scores": """
        SELECT o_custkey AS customer_id,
               last_day(date_trunc('month', o_orderdate)
                        + to_months(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END))
                   AS cutoff_date,
               CAST((o_orderkey % 201) * 0.5 AS DECIMAL(5,1)) AS contact_score,
               CAST(o_orderkey % 83 AS DECIMAL(5,1)) AS agreement_score,
               CAST(o_orderkey % 79 AS DECIMAL(5,1)) AS payment_score,
               CAST(o_orderkey % 73 AS DECIMAL(5,1)) AS general_score,
               CAST(o_orderkey % 12 AS INTEGER) AS payment_rank
        FROM orders""",
    "exposure": """
        SELECT c_custkey AS customer_id,
               CAST(c_acctbal AS DECIMAL(12,2)) AS overdue_balance,
               CAST(100 + c_custkey % 50 AS DECIMAL(12,2)) AS base_fee,
               CAST(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal
                         ELSE c_acctbal + c_custkey % 300 END AS DECIMAL(12,2))
                   AS current_balance,
               unnest([DATE '1996-04-30', DATE '1996-05-31']) AS snapshot_date
        FROM customer""",
}


# --- shared expressions -------------------------------------------------------------


def _in(values) -> str:
    return "(" + ", ".join(repr(v) for v in values) + ")"


def _by_day(ts: str, w: DayWindow) -> str:
    return f"CAST({ts} AS DATE) BETWEEN DATE '{w.start}' AND DATE '{w.end}'"


def _by_instant(ts: str, w: DayWindow) -> str:
    return f"{ts} BETWEEN TIMESTAMP '{w.start} 00:00:00' AND TIMESTAMP '{w.end} 00:00:00'"


def _month(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m')"


def _text(column: str) -> str:
    return f"CAST({column} AS VARCHAR) AS {column.split('.')[-1]}"


def _half_up(num: str, den: str, digits: int) -> str:
    """Non-negative quotient, rounded half up in whole numbers."""
    return (
        f"CAST((2 * {10**digits} * CAST({num} AS HUGEINT) + CAST({den} AS HUGEINT))"
        f" // (2 * nullif(CAST({den} AS HUGEINT), 0)) AS DOUBLE) / {10**digits}"
    )


def _percent(num: str, den: str) -> str:
    """Percentage of two money sums, from their cents."""
    return _half_up(f"({num}) * 10000", f"({den}) * 100", 2)


def _mean(column: str, digits: int) -> str:
    """Mean of a column with two decimals, from its cents."""
    size = 10 ** (digits - 2)
    return (
        f"CAST((2 * {size} * CAST(sum({column}) * 100 AS HUGEINT) + count({column}))"
        f" // (2 * nullif(count({column}), 0)) AS DOUBLE) / {10**digits}"
    )


BUCKET = (
    "CASE WHEN past_due BETWEEN 1 AND 6 OR past_due < 0 THEN past_due"
    " WHEN past_due = 0 THEN 1 ELSE 7 END"
)
AGE = "CAST(round((record_date - birth_date) / 365.25) AS INTEGER)"


def _age_bracket(age: str, labels=b.AGE_BRACKETS) -> str:
    young, second, third, old = labels
    return (
        f"CASE WHEN {age} IS NULL OR {age} > 60 THEN '{old}'"
        f" WHEN {age} > 40 THEN '{third}'"
        f" WHEN {age} >= 25 THEN '{second}' ELSE '{young}' END"
    )


SATURATION = (
    f"CASE WHEN saturation_pct IS NULL OR saturation_pct > 60 THEN '{b.SATURATION_HIGH}'"
    f" WHEN saturation_pct >= 20 THEN '{b.SATURATION_MEDIUM}' ELSE '{b.SATURATION_LOW}' END"
)
RECENCY = (
    "CASE WHEN last_contact_date IS NULL OR record_date - last_contact_date > 30"
    f" THEN '{b.RECENCY_NONE}'"
    f" WHEN record_date - last_contact_date > 7 THEN '{b.RECENCY_MODERATE}'"
    f" ELSE '{b.RECENCY_RECENT}' END"
)
# Compared as products: incomes here are not negative, and no quotient is rounded.
LOAD = (
    f"CASE WHEN income IS NULL OR income = 0 OR balance * 2 > income THEN '{b.LOAD_HIGH}'"
    f" WHEN balance * 5 >= income THEN '{b.LOAD_MEDIUM}' ELSE '{b.LOAD_LOW}' END"
)
CONTACTABILITY = (
    f"CASE WHEN contact_score >= 70 THEN '{b.CONTACTABILITY_HIGH}'"
    f" WHEN contact_score >= 30 AND contact_score <= 69 THEN '{b.CONTACTABILITY_MEDIUM}'"
    f" ELSE '{b.CONTACTABILITY_LOW}' END"
)
DUE = (
    "CASE WHEN overdue_balance <= 0 THEN base_fee"
    " WHEN current_balance = overdue_balance THEN overdue_balance"
    " WHEN overdue_balance > 0 THEN least(overdue_balance + base_fee, current_balance) END"
)


# --- derived tables ------------------------------------------------------------------


def snapshot(
    w: DayWindow, balance: bool = True, account: str = "account_id", ties: str = "load_id"
) -> str:
    positive = "AND balance > 0" if balance else ""
    return f"""
        SELECT *, account_id // 10 AS customer_id, {BUCKET} AS risk_bucket
        FROM (SELECT * REPLACE ({account} AS account_id),
                     CAST(load_ts AS DATE) AS record_date, {_month('load_ts')} AS month_year
              FROM portfolio)
        WHERE account_id > 0 {positive} AND {_by_day('load_ts', w)}
        QUALIFY row_number() OVER (PARTITION BY account_id, month_year
                                   ORDER BY record_date, {ties}) = 1"""


def excluded(w: DayWindow) -> str:
    return f"""
        SELECT DISTINCT customer_id, {_month('load_ts')} AS month_year FROM third_party
        WHERE channel IN {_in(WHOLE.channels)} AND {_by_instant('load_ts', w)}"""


def managed(key: str = "customer_id") -> str:
    return f"""
        SELECT s.* FROM snapshot s
        LEFT JOIN excluded e ON e.customer_id = s.{key} AND e.month_year = s.month_year
        WHERE e.customer_id IS NULL"""


def calls(w: DayWindow) -> str:
    return f"""
        SELECT *, account_id // 10 AS customer_id, CAST(start_ts AS DATE) AS call_day,
               {_month('start_ts')} AS month_year
        FROM (SELECT DISTINCT * FROM interactions)
        WHERE kind = '{WHOLE.phone_kind}' AND {_by_day('start_ts', w)}"""


def daily(w: DayWindow) -> str:
    return f"""
        SELECT customer_id, CAST(payment_ts AS DATE) AS payment_date,
               {_month('payment_ts')} AS month_year, sum(amount) AS paid_amount
        FROM payments
        WHERE payment_kind = '{WHOLE.payment_kind}' AND {_by_instant('payment_ts', w)}
        GROUP BY ALL"""


ACTIVITY = f"""
    SELECT customer_id, month_year, count(*) AS total_calls,
           count(*) FILTER (outcome_code IN {_in(RPC_CODES)}) AS total_contacts,
           count(*) FILTER (outcome_code IN {_in(AGREEMENT_CODES)}) AS total_agreements
    FROM calls GROUP BY ALL"""

MONTH_SCORES = f"""
    SELECT *, {_month('cutoff_date')} AS month_year FROM scores
    WHERE cutoff_date BETWEEN DATE '{SPAN.start}' - 1 AND DATE '{SPAN.end}'"""

LATEST = """
    SELECT * FROM month_scores
    QUALIFY row_number() OVER (
        PARTITION BY customer_id, month_year
        ORDER BY cutoff_date DESC, contact_score, agreement_score, payment_score,
                 general_score, payment_rank) = 1"""

RECOVERY = """
    SELECT m.*, d.payment_date, coalesce(d.paid_amount, 0) AS recovered_amount
    FROM managed m
    LEFT JOIN daily d ON d.customer_id = m.customer_id AND d.month_year = m.month_year
                     AND d.payment_date >= m.record_date"""

# One row per account, score row and payment day.
FULL_MESH = """
    SELECT r.*, s.contact_score, s.payment_rank
    FROM recovery r
    LEFT JOIN month_scores s USING (customer_id, month_year)"""

NET = """
    SELECT m.account_id, m.month_year, any_value(m.customer_id) AS customer_id,
           any_value(m.record_date) AS record_date, any_value(m.balance) AS balance,
           any_value(m.risk_bucket) AS risk_bucket, any_value(m.income) AS income,
           any_value(m.birth_date) AS birth_date, any_value(m.punctuality) AS punctuality,
           any_value(m.model_efficiency) AS model_efficiency,
           CASE WHEN row_number() OVER (
                         PARTITION BY any_value(m.customer_id), m.month_year
                         ORDER BY any_value(m.record_date), m.account_id) = 1
                THEN coalesce(sum(d.paid_amount), 0) ELSE 0 END AS recovered_amount
    FROM managed m
    LEFT JOIN daily d ON d.customer_id = m.customer_id AND d.month_year = m.month_year
                     AND d.payment_date >= m.record_date
    GROUP BY m.account_id, m.month_year"""

# One row per account, with one score row and the sum of its payments.
NET_MESH = """
    SELECT n.*, s.contact_score, s.payment_rank
    FROM net n LEFT JOIN latest s USING (customer_id, month_year)"""

PORTFOLIO_PAYMENTS = f"""
    SELECT p.customer_id, {_month('p.payment_ts')} AS month_year,
           sum(p.amount) AS total_paid_amount
    FROM payments p
    JOIN snapshot s ON s.customer_id = p.customer_id
                   AND s.month_year = {_month('p.payment_ts')}
    WHERE p.payment_kind = '{WHOLE.payment_kind}' AND {_by_instant('p.payment_ts', SPAN)}
    GROUP BY ALL"""

DERIVED = {
    "snapshot": snapshot(SPAN),
    "excluded": excluded(SPAN),
    "managed": managed(),
    "calls": calls(SPAN),
    "daily": daily(SPAN),
    "activity": ACTIVITY,
    "month_scores": MONTH_SCORES,
    "latest": LATEST,
    "recovery": RECOVERY,
    "full_mesh": FULL_MESH,
    "net": NET,
    "net_mesh": NET_MESH,
    "portfolio_payments": PORTFOLIO_PAYMENTS,
}
NEEDS = {
    "snapshot": ["portfolio"],
    "excluded": ["third_party"],
    "managed": ["snapshot", "excluded"],
    "calls": ["interactions"],
    "daily": ["payments"],
    "activity": ["calls"],
    "month_scores": ["scores"],
    "latest": ["month_scores"],
    "recovery": ["managed", "daily"],
    "full_mesh": ["recovery", "month_scores"],
    "net": ["managed", "daily"],
    "net_mesh": ["net", "latest"],
    "portfolio_payments": ["payments", "snapshot"],
}


def add(name: str, needs: str, select: str, **replaced: str) -> None:
    """Register ``select`` with the tables it needs; ``replaced`` redefines some."""
    _PARTS[name] = (needs, select, replaced)
    ORACLE_SQL[name] = sql(name)


def sql(name: str, inputs: dict[str, str] = INPUTS) -> str:
    """The SQL of a query, over the test tables or any other definition of the
    six input tables."""
    needs, select, replaced = _PARTS[name]
    tables = {**inputs, **DERIVED, **replaced}
    ordered: list[str] = []

    def visit(table: str) -> None:
        if table not in ordered:
            for other in NEEDS.get(table, []):
                visit(other)
            ordered.append(table)

    for table in needs.split():
        visit(table)
    ctes = ",\n".join(f"{t} AS ({tables[t]})" for t in ordered)
    return f"WITH {ctes}\n{select}"


# --- snapshot and exclusion ------------------------------------------------------------

add(
    "snapshot_first_of_month",
    "snapshot",
    f"""SELECT account_id, customer_id, load_id, {_text('record_date')}, month_year,
              risk_bucket, CAST(balance AS DOUBLE) AS balance FROM snapshot""",
)
add(
    "risk_bucket_counts",
    "portfolio",
    f"SELECT past_due, {BUCKET} AS risk_bucket, count(*) AS loads FROM portfolio GROUP BY ALL",
)
add(
    "strip_check_digit",
    "portfolio",
    """SELECT account_id // 10 AS customer_id, count(DISTINCT account_id) AS accounts,
              count(*) AS loads FROM portfolio GROUP BY ALL""",
)
add(
    "month_key_volume",
    "portfolio",
    f"""SELECT {_month('load_ts')} AS month_year, CAST(last_day(load_ts) AS VARCHAR) AS month_end,
               count(*) AS loads, CAST(sum(balance) AS DOUBLE) AS balance
        FROM portfolio GROUP BY ALL""",
)
add("exclusion_list_monthly", "excluded", "SELECT customer_id, month_year FROM excluded")
add(
    "exclusion_list_window",
    "excluded",
    "SELECT DISTINCT customer_id FROM excluded",
    excluded=excluded(FUNNEL.window),
)
add(
    "portfolio_after_exclusion",
    "managed",
    "SELECT account_id, customer_id, month_year, risk_bucket FROM managed",
)
add(
    "portfolio_after_exclusion_window",
    "snapshot excluded",
    """SELECT account_id, customer_id, month_year, risk_bucket FROM snapshot s
       WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.customer_id = s.customer_id)""",
    excluded=excluded(FUNNEL.window),
)
add(
    "uncast_window_payments",
    "payments",
    f"""SELECT payment_kind,
          count(*) FILTER ({_by_day('payment_ts', YEAR)}) AS payments_by_day,
          count(*) FILTER ({_by_instant('payment_ts', YEAR)}) AS payments_by_instant,
          CAST(sum(amount) FILTER ({_by_day('payment_ts', YEAR)}) AS DOUBLE)
              AS amount_by_day,
          CAST(sum(amount) FILTER ({_by_instant('payment_ts', YEAR)}) AS DOUBLE)
              AS amount_by_instant
        FROM payments GROUP BY ALL""",
)

# --- calls --------------------------------------------------------------------------------

add(
    "interactions_distinct",
    "interactions",
    f"""SELECT {_month('start_ts')} AS month_year, kind, count(*) AS events
        FROM (SELECT DISTINCT * FROM interactions) GROUP BY ALL""",
)
add("contact_activity_monthly", "activity", "SELECT * FROM activity")
add(
    "rejected_times",
    "interactions",
    """SELECT CASE WHEN start_ts IS NULL THEN 'kept'
                   WHEN agent_id % 5 = 0 THEN 'start_ts: value'
                   WHEN agent_id % 5 = 1 THEN 'start_ts: form'
                   ELSE 'kept' END AS fault,
              count(*) AS rows
       FROM interactions GROUP BY ALL""",
)
add(
    "contact_flags",
    "managed activity",
    """SELECT m.account_id, m.month_year, coalesce(a.total_contacts, 0) AS total_contacts,
              CAST(coalesce(a.total_contacts, 0) > 0 AS INTEGER) AS is_contacted
       FROM managed m LEFT JOIN activity a USING (customer_id, month_year)""",
)
add(
    "agreements_monthly",
    "calls",
    f"""SELECT DISTINCT customer_id, month_year FROM calls
        WHERE outcome_code IN {_in(AGREEMENT_CODES)}""",
)

PROMISES = """(SELECT DISTINCT customer_id, kind, outcome_code, agent_id, call_day,
                     least(last_day(call_day),
                           CAST(call_day + coalesce(term_weeks * 7, 99) AS DATE))
                         AS promise_end_date
              FROM calls)"""
add(
    "non_system_calls",
    "calls",
    f"""SELECT customer_id, count(*) AS n_calls,
               CAST(count(*) FILTER (outcome_code <> {WHOLE.system_code}) > 0 AS INTEGER)
                   AS dialed,
               CAST(count(*) FILTER (outcome_code IN {_in(RPC_CODES)}) > 0 AS INTEGER) AS rpc,
               CAST(count(*) FILTER (outcome_code IN {_in(AGREEMENT_CODES)}) > 0 AS INTEGER)
                   AS agreed
        FROM {PROMISES} GROUP BY ALL""",
)
add(
    "promise_end_dates",
    "calls",
    f"""SELECT {_text('call_day')}, {_text('promise_end_date')}, count(*) AS calls
        FROM {PROMISES} GROUP BY ALL""",
)
add(
    "outcome_taxonomy",
    "calls",
    f"""SELECT month_year,
               CASE WHEN outcome_code IN {_in(AGREEMENT_CODES)} THEN 'Agreements'
                    WHEN outcome_code = {WHOLE.system_code} THEN 'System Exclusions'
                    ELSE 'Unmapped' END AS outcome_category,
               count(*) AS calls
        FROM calls GROUP BY ALL""",
)

# --- payments --------------------------------------------------------------------------------

add(
    "daily_payments",
    "daily",
    f"""SELECT customer_id, {_text('payment_date')}, month_year,
              CAST(paid_amount AS DOUBLE) AS paid_amount FROM daily""",
)
add(
    "monthly_portfolio_payments",
    "portfolio_payments",
    """SELECT customer_id, month_year,
              CAST(total_paid_amount AS DOUBLE) AS total_paid_amount
       FROM portfolio_payments""",
)
add(
    "post_assignment_recovery",
    "recovery",
    f"""SELECT account_id, month_year, {_text('record_date')}, {_text('payment_date')},
              CAST(balance AS DOUBLE) AS balance,
              CAST(recovered_amount AS DOUBLE) AS recovered_amount FROM recovery""",
)
add(
    "post_assignment_recovery_net",
    "net",
    f"""SELECT account_id, customer_id, month_year, {_text('record_date')},
              CAST(balance AS DOUBLE) AS balance,
              CAST(recovered_amount AS DOUBLE) AS recovered_amount FROM net""",
)

# --- scores ------------------------------------------------------------------------------------

SCORE_LIST = ", ".join(
    f"CAST(s.{c} AS DOUBLE) AS {c}"
    for c in (
        "contact_score", "agreement_score", "payment_score", "general_score", "payment_rank",
    )
)
add(
    "score_attach",
    "managed month_scores",
    f"""SELECT m.account_id, m.customer_id, m.month_year, {SCORE_LIST}
        FROM managed m LEFT JOIN month_scores s USING (customer_id, month_year)""",
)
add(
    "score_attach_previous_month",
    "managed month_scores",
    f"""SELECT m.account_id, m.customer_id, m.month_year, {SCORE_LIST}
        FROM managed m
        LEFT JOIN month_scores s
               ON s.customer_id = m.customer_id
              AND {_month("date_trunc('month', s.cutoff_date) + INTERVAL 1 MONTH")}
                  = m.month_year""",
)
for _name, _cutoff, _lag in (
    ("score_attach_lag2", "s.cutoff_date", 2),
    ("score_attach_midmonth", "s.cutoff_date - 10", 1),
):
    _met = f"date_trunc('month', {_cutoff}) + INTERVAL {_lag} MONTH"
    add(
        _name,
        "managed scores",
        f"""SELECT m.account_id, m.customer_id, m.month_year, {SCORE_LIST}
            FROM managed m
            LEFT JOIN scores s ON s.customer_id = m.customer_id
                              AND {_month(_met)} = m.month_year""",
        snapshot=snapshot(YEAR),
        excluded=excluded(YEAR),
    )
add(
    "score_row_counts",
    "month_scores",
    """SELECT customer_id, month_year, CAST(payment_rank AS DOUBLE) AS payment_rank,
              count(*) AS score_rows
       FROM month_scores GROUP BY ALL""",
)
add(
    "latest_scores",
    "latest",
    f"SELECT customer_id, month_year, {SCORE_LIST} FROM latest s",
)

# --- bands --------------------------------------------------------------------------------------


def _mix(name: str, **columns: str) -> None:
    listed = ", ".join(f"{sql} AS {column}" for column, sql in columns.items())
    add(
        name,
        "snapshot",
        f"""SELECT {listed}, count(*) AS accounts, CAST(sum(balance) AS DOUBLE) AS balance
            FROM snapshot GROUP BY ALL""",
    )


_mix("age_bracket_mix", customer_age=f"CAST({AGE} AS DOUBLE)", age_bracket=_age_bracket(AGE))
_mix("saturation_mix", saturation_range=SATURATION)
_mix("recency_mix", contact_recency_range=RECENCY)
_mix("reason_mix", non_payment_reason_code="coalesce(reason_code, 0)")
_mix("load_tier_mix", financial_load_tier=LOAD)
add(
    "financial_load_pct",
    "snapshot",
    f"""SELECT account_id, load_id, {_half_up('balance * 10000', 'income * 100', 2)}
               AS financial_load_pct
        FROM snapshot""",
)
add(
    "contactability_mix",
    "scores",
    f"""SELECT {CONTACTABILITY} AS contactability_tier, count(*) AS score_rows,
               CAST(sum(contact_score) AS DOUBLE) AS score_sum
        FROM scores GROUP BY ALL""",
)
add(
    "amount_due_by_branch",
    "exposure",
    f"""SELECT CASE WHEN overdue_balance <= 0 THEN 'base fee'
                    WHEN current_balance = overdue_balance THEN 'overdue'
                    ELSE 'overdue and fee' END AS branch,
               count(*) AS customers, CAST(sum({DUE}) AS DOUBLE) AS amount_due
        FROM exposure WHERE snapshot_date = DATE '{EXPOSURE_DATE}' GROUP BY ALL""",
)

# --- efficiency ------------------------------------------------------------------------------------

TOTALS = """CAST(sum(balance) AS DOUBLE) AS total_assigned_balance,
            CAST(sum(recovered_amount) AS DOUBLE) AS total_recovered_amount"""
EFFICIENCY = _percent("sum(recovered_amount)", "sum(balance)")
TIER = "'Score Tier ' || CAST(payment_rank AS VARCHAR)"
BUCKET_LABEL = "'Bucket ' || CAST(risk_bucket AS VARCHAR)"

for _name, _label in (
    ("efficiency_by_score_tier", TIER),
    ("efficiency_by_bucket", BUCKET_LABEL),
):
    add(
        _name,
        "full_mesh",
        f"""SELECT {_label} AS category, count(DISTINCT customer_id) AS total_customers,
                   CAST(count(*) AS DOUBLE) AS mesh_rows, {TOTALS},
                   {EFFICIENCY} AS real_efficiency_pct
            FROM full_mesh GROUP BY ALL""",
    )
add(
    "efficiency_by_month",
    "net",
    f"""SELECT month_year, count(*) AS accounts, CAST(sum(balance) AS DOUBLE) AS balance,
               CAST(sum(recovered_amount) AS DOUBLE) AS recovered,
               {EFFICIENCY} AS efficiency_pct
        FROM net GROUP BY ALL""",
)

_WIDE = "(2 * 100 * CAST(sum(balance) * 100 AS HUGEINT) * 1000000000000 + count(*))"
add(
    "wide_money_percent",
    "snapshot",
    f"""SELECT risk_bucket, CAST(q // 100 AS VARCHAR) || '.'
                            || lpad(CAST(q % 100 AS VARCHAR), 2, '0') AS pct
        FROM (SELECT risk_bucket, {_WIDE} // (2 * count(*)) AS q FROM snapshot GROUP BY ALL)""",
)

# --- full analyses -----------------------------------------------------------------------------------


def _cells(w: DayWindow, value: str, label) -> str:
    return ", ".join(
        f"count({value}) FILTER (month_year = '{m}') AS \"{label(m)}\""
        for m in w.month_keys()
    )


for _name, _key in (("p01a", "account_id"), ("p01a_stripped", "customer_id")):
    add(
        _name,
        "managed",
        f"""SELECT risk_bucket, {_cells(YEAR, 'customer_id', str)}
            FROM managed GROUP BY risk_bucket""",
        snapshot=snapshot(YEAR, balance=False),
        excluded=excluded(YEAR),
        managed=managed(_key),
    )
add(
    "p01a_no_load_id",
    "managed",
    f"""SELECT risk_bucket, {_cells(YEAR, 'customer_id', str)}
        FROM managed GROUP BY risk_bucket""",
    snapshot=snapshot(YEAR, balance=False, ties="past_due NULLS FIRST"),
    excluded=excluded(YEAR),
    managed=managed("account_id"),
)
add(
    "p01b",
    "managed calls",
    """SELECT m.month_year, m.risk_bucket,
              count(DISTINCT m.customer_id) AS covered_customers
       FROM managed m JOIN calls c USING (customer_id, month_year) GROUP BY ALL""",
)


def _p02(mesh: str) -> str:
    parts = [
        f"""SELECT '{analysis}' AS analysis_type, {label} AS category,
                   count(DISTINCT customer_id) AS total_customers, {TOTALS},
                   {EFFICIENCY} AS efficiency_percentage
            FROM {mesh} GROUP BY ALL"""
        for analysis, label in (
            ("By Predictive Score", TIER),
            ("By Risk Bucket", BUCKET_LABEL),
        )
    ]
    return "\nUNION ALL\n".join(parts)


add("p02", "full_mesh", _p02("full_mesh"))
add("p02_net", "net_mesh", _p02("net_mesh"))

MONTH_PAYMENTS = """
    SELECT customer_id, month_year, sum(paid_amount) AS total_paid_amount
    FROM daily GROUP BY ALL"""
_FIRST_ACCOUNT = """CASE WHEN row_number() OVER (PARTITION BY customer_id, month_year
                                              ORDER BY record_date, account_id) = 1
                         THEN coalesce(p.total_paid_amount, 0) ELSE 0 END"""
for _name, _paid, _customers, _counted in (
    ("p03", "portfolio_payments", "count(*)", "coalesce(p.total_paid_amount, 0)"),
    ("p03_net", f"({MONTH_PAYMENTS})", "count(DISTINCT customer_id)", _FIRST_ACCOUNT),
):
    add(
        _name,
        "managed portfolio_payments daily",
        f"""SELECT risk_bucket, non_payment_reason_code, age_bracket, saturation_range,
                   contact_recency_range, {_customers} AS total_customers,
                   CAST(sum(age) AS DOUBLE) / count(age) AS avg_group_age, {TOTALS},
                   {EFFICIENCY} AS real_efficiency_pct
            FROM (SELECT m.customer_id, m.risk_bucket, m.balance,
                         coalesce(reason_code, 0) AS non_payment_reason_code,
                         {AGE} AS age, {_age_bracket(AGE)} AS age_bracket,
                         {SATURATION} AS saturation_range,
                         {RECENCY} AS contact_recency_range,
                         {_counted} AS recovered_amount
                  FROM managed m
                  LEFT JOIN {_paid} p USING (customer_id, month_year))
            GROUP BY ALL""",
    )
add(
    "p03_no_load_id",
    "managed portfolio_payments daily",
    _PARTS["p03"][1],
    snapshot=snapshot(
        SPAN,
        ties="past_due NULLS FIRST, balance, birth_date NULLS FIRST, saturation_pct NULLS FIRST, "
        "last_contact_date NULLS FIRST, reason_code NULLS FIRST",
    ),
)
for _name, _mesh in (("p04", "full_mesh"), ("p04_net", "net_mesh")):
    add(
        _name,
        _mesh,
        f"""SELECT risk_bucket, punctuality AS punctuality_score, age_bracket,
                   contactability_tier, financial_load_tier,
                   count(DISTINCT customer_id) AS total_customers,
                   {_mean('income', 6)} AS avg_monthly_income, {TOTALS},
                   {EFFICIENCY} AS real_efficiency_pct
            FROM (SELECT *, {_age_bracket(AGE)} AS age_bracket,
                         {CONTACTABILITY} AS contactability_tier,
                         {LOAD} AS financial_load_tier
                  FROM {_mesh})
            GROUP BY risk_bucket, punctuality, age_bracket, contactability_tier,
                     financial_load_tier""",
    )
for _name, _mesh in (("p07", "full_mesh"), ("p07_net", "net")):
    add(
        _name,
        _mesh,
        f"""SELECT risk_bucket AS bucket_mora, {_age_bracket(AGE, b.AGE_BRACKETS_SHORT)} AS rango_edad,
                   count(DISTINCT customer_id) AS total_clientes,
                   {_mean('income', 2)} AS ingreso_promedio,
                   {_mean('model_efficiency', 2)} AS eficiencia_teorica_pct,
                   {EFFICIENCY} AS eficiencia_real_pct
            FROM {_mesh} GROUP BY ALL""",
    )

# The funnel's sources share one id space: the account id is the customer id.
FUNNEL_TABLES = {
    "snapshot": snapshot(FUNNEL.window, account="account_id // 10"),
    "excluded": excluded(FUNNEL.window),
    "calls": calls(FUNNEL.window),
    "daily": daily(FUNNEL.window),
}
FUNNEL_ROWS = f"""
    SELECT s.risk_bucket, s.account_id, s.record_date, c.customer_id AS called,
           c.outcome_code, d.payment_date, f.due
    FROM snapshot s
    LEFT JOIN {PROMISES} c ON c.customer_id = s.account_id
    LEFT JOIN daily d ON d.customer_id = s.account_id
    LEFT JOIN (SELECT customer_id, {DUE} AS due FROM exposure
               WHERE snapshot_date = DATE '{EXPOSURE_DATE}') f
           ON f.customer_id = s.account_id
    WHERE s.account_id NOT IN (SELECT customer_id FROM excluded)"""


def _stage(condition: str) -> str:
    return f"count(DISTINCT account_id) FILTER ({condition})"


STAGES = {
    "total_cartera_asignada": "count(DISTINCT account_id)",
    "clientes_llamada_enlazada": _stage(f"outcome_code <> {WHOLE.system_code}"),
    "clientes_contacto_efectivo": _stage(f"outcome_code IN {_in(RPC_CODES)}"),
    "clientes_con_convenio": _stage(f"outcome_code IN {_in(AGREEMENT_CODES)}"),
    "clientes_pagadores": _stage("payment_date >= record_date"),
}
STAGE_LIST = ", ".join(f"{sql} AS {name}" for name, sql in STAGES.items())
add(
    "p05",
    "snapshot excluded calls daily exposure",
    f"""SELECT risk_bucket AS mora_bucket, {STAGE_LIST},
               CAST(sum(due) AS DOUBLE) AS exigible_total_monto
        FROM ({FUNNEL_ROWS}) GROUP BY risk_bucket""",
    **FUNNEL_TABLES,
)
add(
    "p05_net",
    "snapshot excluded calls daily exposure",
    f"""SELECT c.*, n.exigible_total_monto
        FROM (SELECT risk_bucket AS mora_bucket, {STAGE_LIST}
              FROM ({FUNNEL_ROWS}) GROUP BY risk_bucket) c
        JOIN (SELECT risk_bucket AS mora_bucket, CAST(sum({DUE}) AS DOUBLE)
                         AS exigible_total_monto
              FROM snapshot s
              LEFT JOIN exposure f ON f.customer_id = s.account_id
                                  AND f.snapshot_date = DATE '{EXPOSURE_DATE}'
              WHERE s.account_id NOT IN (SELECT customer_id FROM excluded)
              GROUP BY risk_bucket) n USING (mora_bucket)""",
    **FUNNEL_TABLES,
)
add(
    "funnel_rates",
    "snapshot excluded calls daily exposure",
    f"""SELECT c.*, {_half_up('rpc_customers * 100', 'assigned_customers', 2)}
                   AS rpc_contact_rate_pct,
               {_half_up('agreement_customers * 100', 'rpc_customers', 2)}
                   AS agreement_conversion_rate_pct
        FROM (SELECT risk_bucket,
                     {STAGES['total_cartera_asignada']} AS assigned_customers,
                     {STAGES['clientes_llamada_enlazada']} AS dialed_customers,
                     {STAGES['clientes_contacto_efectivo']} AS rpc_customers,
                     {STAGES['clientes_con_convenio']} AS agreement_customers,
                     {STAGES['clientes_pagadores']} AS paying_customers,
                     CAST(sum(due) AS DOUBLE) AS total_amount_due
              FROM ({FUNNEL_ROWS}) GROUP BY risk_bucket) c""",
    **FUNNEL_TABLES,
)
add(
    "p06",
    "managed calls",
    f"""SELECT risk_bucket AS bucket_mora,
               {_cells(YEAR, 'DISTINCT customer_id', spanish_month_label)}
        FROM (SELECT m.* FROM managed m JOIN calls c USING (customer_id, month_year)
              WHERE c.outcome_code IN {_in(AGREEMENT_CODES)})
        GROUP BY risk_bucket""",
    snapshot=snapshot(YEAR),
    excluded=excluded(YEAR),
    calls=calls(YEAR),
)

# A customer's payments of a month count once, in the bucket of its first account.
KPIS = f"""
    SELECT month_year, risk_bucket, assigned_customers, rpc_customers,
           agreement_customers, realized_recovery,
           {_half_up('rpc_customers * 100', 'assigned_customers', 2)}
               AS rpc_contact_rate_pct,
           {_half_up('agreement_customers * 100', 'rpc_customers', 2)}
               AS agreement_conversion_rate_pct
    FROM (SELECT c.month_year, c.risk_bucket,
                 count(DISTINCT c.customer_id) AS assigned_customers,
                 count(DISTINCT c.customer_id) FILTER (a.total_contacts > 0)
                     AS rpc_customers,
                 count(DISTINCT c.customer_id) FILTER (a.total_agreements > 0)
                     AS agreement_customers,
                 CAST(coalesce(sum(r.paid), 0) AS DOUBLE) AS realized_recovery
          FROM bucket_customers c
          LEFT JOIN activity a USING (customer_id, month_year)
          LEFT JOIN (SELECT m.customer_id, m.month_year, m.risk_bucket,
                            sum(d.paid_amount) AS paid
                     FROM (SELECT * FROM managed
                           QUALIFY row_number() OVER (
                               PARTITION BY customer_id, month_year
                               ORDER BY record_date, account_id) = 1) m
                     JOIN daily d ON d.customer_id = m.customer_id
                                 AND d.month_year = m.month_year
                                 AND d.payment_date >= m.record_date
                     GROUP BY ALL) r USING (customer_id, month_year, risk_bucket)
          GROUP BY ALL)"""
DERIVED["bucket_customers"] = """
    SELECT DISTINCT customer_id, month_year, risk_bucket FROM managed"""
NEEDS["bucket_customers"] = ["managed"]
add("kpi_rates", "managed bucket_customers activity daily", KPIS)
_ROLLING = DayWindow(date(1995, 1, 1), date(2001, 12, 31))
_LAST_YEAR = DayWindow(date(1996, 2, 1), date(1997, 1, 31))


def _rolling(window: DayWindow) -> str:
    cells = ", ".join(
        f"max(value) FILTER (month_year = '{m}') AS \"{m}\"" for m in window.month_keys()
    )
    return f"""SELECT risk_bucket, kpi, {cells}
        FROM (SELECT month_year, risk_bucket,
                     CAST(assigned_customers AS DOUBLE) AS assigned_customers,
                     rpc_contact_rate_pct, agreement_conversion_rate_pct,
                     realized_recovery
              FROM ({KPIS}))
             UNPIVOT INCLUDE NULLS (value FOR kpi IN (
                 assigned_customers, rpc_contact_rate_pct,
                 agreement_conversion_rate_pct, realized_recovery))
        GROUP BY risk_bucket, kpi"""


add("rolling_kpis", "managed bucket_customers activity daily", _rolling(_ROLLING))
add(
    "rolling_kpis_year",
    "managed bucket_customers activity daily",
    _rolling(_LAST_YEAR),
    snapshot=snapshot(_LAST_YEAR),
    excluded=excluded(_LAST_YEAR),
    calls=calls(_LAST_YEAR),
    daily=daily(_LAST_YEAR),
)
add(
    "span_kpis",
    "managed bucket_customers activity",
    """SELECT c.risk_bucket, count(DISTINCT c.customer_id) AS assigned_customers,
              count(DISTINCT c.customer_id) FILTER (a.total_contacts > 0) AS rpc_customers,
              count(DISTINCT c.customer_id) FILTER (a.total_agreements > 0)
                  AS agreement_customers
       FROM bucket_customers c LEFT JOIN activity a USING (customer_id, month_year)
       GROUP BY ALL""",
)
add(
    "rolling_months_pivot",
    "managed",
    f"""SELECT risk_bucket, {_cells(_ROLLING, 'DISTINCT customer_id', str)}
        FROM managed GROUP BY risk_bucket""",
)

# --- the source vocabularies, stored tables and the published order ------------------------------------------

for _name, _same in (
    ("p02_staging_names", "p02"),
    ("p05_core_names", "p05"),
    ("p07_directory_names", "p07"),
    ("p01a_by_month", "p01a"),
    ("p02_by_month", "p02"),
    ("p05_by_month", "p05"),
    ("rolling_kpis_by_month", "rolling_kpis_year"),
    ("contact_activity_wide", "contact_activity_monthly"),
    ("kpi_rates_from_states", "kpi_rates"),
    ("rolling_kpis_month_added", "rolling_kpis_year"),
    ("p05_text_times", "p05"),
):
    add(_name, *_PARTS[_same][:2], **_PARTS[_same][2])
for _name, _of, _keys, _order in (
    ("p01b_order", "p01b", "month_year, risk_bucket", "month_year, risk_bucket"),
    ("p02_order", "p02", "analysis_type, category",
     "analysis_type, category NULLS LAST"),
    ("p04_order", "p04", "risk_bucket, age_bracket, real_efficiency_pct",
     "risk_bucket, age_bracket, real_efficiency_pct DESC NULLS FIRST"),
    ("p05_order", "p05", "mora_bucket", "mora_bucket NULLS LAST"),
):
    add(
        _name,
        _PARTS[_of][0],
        f"SELECT row_number() OVER (ORDER BY {_order}) AS place, {_keys} FROM ({_PARTS[_of][1]})",
        **_PARTS[_of][2],
    )
