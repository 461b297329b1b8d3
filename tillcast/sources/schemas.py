"""Schemas of the domain tables; every reader states its schema, none is inferred."""

from __future__ import annotations

SALES = "date date, branch string, item_group string, item_name string, qty_sold double"
ENRICHED = (
    f"{SALES}, day string, is_weekend boolean, "
    "temperature_2m_max double, temperature_2m_min double"
)
#: Mergeable sums of one series and month of the enriched sales.
STATISTICS = (
    "branch string, item_name string, n_rows bigint, n_values bigint, last_date date, "
    "print bigint, max_sum double, max_count bigint, min_sum double, min_count bigint"
)
#: What a streamed batch added to the store.
LEDGER = "n_lines bigint, n_late bigint, first_day date, last_day date, batch bigint"
INVOICE_ITEM = (
    "creation timestamp_ntz, item_group string, item_name string, warehouse string, qty double"
)
LATE_LINE = (
    "creation timestamp_ntz, item_group string, item_name string, qty double, branch string, "
    "batch bigint"
)
FORECAST = "date date, prediction int, item_name string, branch string, item_group string"
WEATHER = (
    "date date, latitude double, longitude double, "
    "temperature_2m_max double, temperature_2m_min double"
)
WEATHER_PAYLOAD = (
    "daily struct<time: array<string>, temperature_2m_max: array<double>, "
    "temperature_2m_min: array<double>>"
)
BRANCH_MAP = "map<string, string>"
BRANCH_INFO = "map<string, struct<city: string, latitude: double, longitude: double>>"
PRICE = "item_name string, price_list_rate double, currency string"
BALANCE = (
    "item_name string, branch string, item_group string, date date, "
    "balance int, voucher_type string"
)

SALES_KEY = ["date", "branch", "item_group", "item_name"]
SERIES_KEY = ["branch", "item_name"]
