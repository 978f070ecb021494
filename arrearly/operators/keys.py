"""The key of all enrichment: a stripped customer id and the first of a month."""

CUSTOMER_MONTH = ["customer_id", "month"]
