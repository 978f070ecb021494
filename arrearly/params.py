"""Windows, code sets and per-vocabulary settings of the analyses."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: call outcome codes -------------------------------------
# Codes that count as a right-party contact (effective contact).
RPC_CODES = (1, 2, 3, 4, 5, 6, 7, 9, 22, 25, 30, 34, 35, 39)
# Codes that record a payment agreement.
AGREEMENT_CODES = (1, 35, 39)
# System movement, not a dialled call.
SYSTEM_CODE = 33
# The two outcome categories whose codes are published; the codes of Refusals,
# Callbacks and Claims are not, so callers pass them in.
OUTCOME_TAXONOMY = {
    "Agreements": AGREEMENT_CODES,
    "System Exclusions": (SYSTEM_CODE,),
}

# --- Fixed values: externally managed channels ----------------------------
STAGING_CHANNELS = ("VENDOR_A", "VENDOR_B", "PARTNER_EXTERNAL")
CORE_CHANNELS = (
    "VENDOR_BOT_A", "VENDOR_CAT_B", "VENDOR_DIRECT", "VENDOR_SIGA", "VENDOR_TESTIGO",
)
DIRECTORY_CHANNELS = (
    "IABOTCAT", "IACATCLN", "IACATMX", "IADIRECT", "IALABCLN", "IALABMX", "IASIGA",
    "IAVOICES", "IAVOZY", "SIGA", "PENTAFON", "SIGA_TES", "TESTIGO",
)

# --- Fixed values: Spanish month abbreviations, January first --------------
SPANISH_MONTHS = (
    "ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic",
)


@dataclass(frozen=True)
class DayWindow:
    """A closed range of days."""

    start: date
    end: date

    def by_day(self, ts: Column | str) -> Column:
        """True for every instant of every day of the window.

        Written as a half-open range on the raw column, so that it reaches the
        Parquet scan whether the column is a date or a timestamp.
        """
        ts = F.col(ts) if isinstance(ts, str) else ts
        return (ts >= F.lit(self.start)) & (ts < F.lit(self.end + timedelta(days=1)))

    def by_instant(self, ts: Column | str) -> Column:
        """Closed range on the raw value: the last day counts at 00:00:00 only."""
        ts = F.col(ts) if isinstance(ts, str) else ts
        return ts.between(F.lit(self.start), F.lit(self.end))

    def contains(self, ts: Column | str, whole_last_day: bool) -> Column:
        return self.by_day(ts) if whole_last_day else self.by_instant(ts)

    def month_keys(self) -> list[str]:
        """'YYYY-MM' of every month the window touches, in order."""
        first = self.start.year * 12 + self.start.month - 1
        last = self.end.year * 12 + self.end.month - 1
        return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)]


def rolling_months(end: date, n: int = 13) -> DayWindow:
    """The window of the ``n`` calendar months that end with the month of ``end``."""
    last = end.year * 12 + end.month - 1
    first = last - n + 1
    after = last + 1
    return DayWindow(
        date(first // 12, first % 12 + 1, 1),
        date(after // 12, after % 12 + 1, 1) - timedelta(days=1),
    )


def score_window(window: DayWindow, lag_months: int = 0) -> DayWindow:
    """The cutoff days of the scores that the accounts of ``window`` can meet."""
    if lag_months < 0:
        raise ValueError("a score can not be cut off after the month that it meets")
    if lag_months == 0:
        return DayWindow(window.start - timedelta(days=1), window.end)
    first = window.start.year * 12 + window.start.month - 1 - lag_months
    n = len(window.month_keys())
    return rolling_months(date((first + n - 1) // 12, (first + n - 1) % 12 + 1, 1), n)


def spanish_month_label(month_key: str) -> str:
    year, month = month_key.split("-")
    return f"{SPANISH_MONTHS[int(month) - 1]}_{year}"


@dataclass(frozen=True)
class Settings:
    """What the analyses take as literals: window, channels, kinds and codes."""

    window: DayWindow
    channels: tuple[str, ...]
    phone_kind: str
    payment_kind: str
    rpc_codes: tuple[int, ...] = RPC_CODES
    agreement_codes: tuple[int, ...] = AGREEMENT_CODES
    system_code: int = SYSTEM_CODE
    exposure_date: date | None = None
    # Third-party loads and payments are windowed on the raw timestamp by
    # default, so intraday rows of the last day fall outside.
    whole_last_day: bool = False
    # 0: a month's accounts meet the scores cut off in that month, i.e. at its
    # end. 1: they meet the scores of the month before.
    score_lag_months: int = 0

    def during(self, window: DayWindow) -> "Settings":
        """The same settings for another window. The exposure, where there is one, is
        that of the day before it."""
        before = window.start - timedelta(days=1) if self.exposure_date else None
        return replace(self, window=window, exposure_date=before)


# Published defaults, one per source vocabulary.
HISTORY = DayWindow(date(2025, 6, 1), date(2026, 6, 30))
LAST_MONTH = DayWindow(date(2026, 6, 1), date(2026, 6, 30))

STAGING = Settings(HISTORY, STAGING_CHANNELS, "TELEPHONE", "ACCOUNT_CREDIT")
CORE = Settings(
    LAST_MONTH, CORE_CHANNELS, "T", "ACCOUNT_PAYMENT", exposure_date=date(2026, 5, 31)
)
DIRECTORY = Settings(HISTORY, DIRECTORY_CHANNELS, "T", "CUENTA")
