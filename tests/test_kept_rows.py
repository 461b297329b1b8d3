"""Rows that must not get lost: null keys, unmapped warehouses, short words, gaps in quantities."""

import datetime as dt

from tillcast.operators import enrich, forecast, linking, stock
from tillcast.sources import schemas


def test_forward_fill_keeps_rows_with_null_keys(spark):
    days = [dt.date(2024, 1, 30) + dt.timedelta(n) for n in range(4)]
    rows = [(d, k, 1.0 if n == 0 else None) for k in (None, "a") for n, d in enumerate(days)]
    frame = spark.createDataFrame(rows, "date date, branch string, value double")
    found = enrich.forward_fill(frame, "value", ["branch"], ["date"]).collect()
    assert len(found) == 8 and {r["value"] for r in found} == {1.0}


def test_unmapped_warehouse_is_listed_under_its_code(spark):
    day = dt.date(2024, 1, 1)
    ledger = spark.createDataFrame(
        [(w, "i", day, 2.0, 1) for w in ("known", "lost")],
        "warehouse string, item_code string, posting_date date, qty_after_transaction double,"
        " docstatus int",
    )
    items = spark.createDataFrame([("i", "pie")], "item_code string, item_name string")
    names = spark.createDataFrame([("known", "North")], "code string, branch string")
    found = stock.minimum_balance(ledger, items, names, None, None, day).collect()
    assert sorted(r["branch"] for r in found) == ["North", "lost"]
    chosen = stock.balance_today(ledger, items, names, ["north"], None, day).collect()
    assert [r["branch"] for r in chosen] == ["North"]


def test_words_of_three_characters_may_be_misspelt(spark, rows):
    left = spark.createDataFrame([("rd",), ("a",), ("x9z",), ("12",)], "token string")
    right = spark.createDataFrame([("red",), ("b",), ("x8z",), ("13",)], "token string")
    assert rows(linking.similar_tokens(left, right)) == [("rd", "red"), ("x9z", "x8z")]


def test_forward_forecast_has_the_rule_of_the_backtest(spark):
    start = dt.date(2024, 1, 1)
    quantities = [1.0, 2.0, 3.0, 2.0, 1.0, None, None, 2.0, None, None, 1.0, 2.0]
    rows = [
        (start + dt.timedelta(n), "north", "g", "pie", q, n + 1, False, 20.0, 10.0)
        for n, q in enumerate(quantities)
    ]
    kinds = ", day int, is_weekend boolean, temperature_2m_max double, temperature_2m_min double"
    fact = spark.createDataFrame(rows, schemas.SALES + kinds)
    assert forecast.forecast_forward(fact).count() == forecast.HORIZON
