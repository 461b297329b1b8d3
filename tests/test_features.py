"""Calendar, weather, encoding, filling, text and filter rules on small frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tillcast.functions import calendar, numeric, text
from tillcast.operators import enrich, selection
from tillcast.session import run_dir
from tillcast.sources import readers, schemas

D = dt.date.fromisoformat


def dates(spark, *days):
    return spark.createDataFrame([(D(d),) for d in days], "date date")


def test_weekend_and_label_codes(spark, rows):
    df = dates(spark, "2024-03-01", "2024-03-02", "2024-03-03", "2024-03-04")  # Fri to Mon
    coded = enrich.encode_label(enrich.add_calendar(df), "day")
    assert rows(coded) == [
        (D("2024-03-01"), 0, False),  # Friday, Monday, Saturday, Sunday
        (D("2024-03-02"), 2, True),
        (D("2024-03-03"), 3, True),
        (D("2024-03-04"), 1, False),
    ]


def test_mean_fill_over_everything_and_column_without_values(spark, rows):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("b", 3.0, None), ("c", None, None)], "k string, x double, y double")
    assert rows(enrich.fill_mean(df, ["x", "y"])) == [
        ("a", 1.0, None), ("b", 3.0, None), ("c", 2.0, None)]


def test_forward_fill_crosses_months_but_not_series(spark, rows):
    data = [
        ("n", "i", D("2024-01-30"), 5.0), ("n", "i", D("2024-01-31"), None),
        ("n", "i", D("2024-03-01"), None), ("n", "i", D("2024-03-02"), 7.0),
        ("n", "i", D("2024-03-03"), None), ("s", "i", D("2024-01-01"), None),
    ]
    df = spark.createDataFrame(data, "branch string, item_name string, date date, x double")
    filled = enrich.forward_fill(df, "x", ["branch", "item_name"], ["date"])
    assert [r[3] for r in rows(filled)] == [5.0, 5.0, 5.0, 7.0, 7.0, None]


def test_unknown_branch_gets_no_place_and_mean_weather(spark, rows):
    rollup_rows = spark.createDataFrame(
        [(D("2024-01-01"), "g", "i", "W1", 1.0), (D("2024-01-01"), "g", "i", "W9", 2.0)],
        "date date, item_group string, item_name string, warehouse string, qty_sold double")
    branch_map = spark.createDataFrame([("W1", "north")], "code string, branch string")
    branch_dim = spark.createDataFrame(
        [("north", "Town", 31.5497, 74.3436)],
        "branch string, city string, latitude double, longitude double")
    weather = spark.createDataFrame(
        [(D("2024-01-01"), 31.5497, 74.3436, 20.0, 8.0)], schemas.WEATHER)
    found = enrich.preprocess(rollup_rows, branch_map, branch_dim, weather)
    assert rows(found, "branch", "temperature_2m_max", "temperature_2m_min", "day") == [
        ("W9", 20.0, 8.0, 0), ("north", 20.0, 8.0, 0)]


def test_weather_payload_without_daily_drops_out(spark, rows):
    good = {"daily": {"time": ["2024-01-01", "2024-01-02"],
                      "temperature_2m_max": [20.5, None], "temperature_2m_min": [8.0, 9.0]}}
    payloads = spark.createDataFrame(
        [(1.0, 2.0, json.dumps(good)), (3.0, 4.0, json.dumps({"error": True}))],
        "latitude double, longitude double, payload string")
    assert rows(readers.weather_from_payload(payloads)) == [
        (D("2024-01-01"), 1.0, 2.0, 20.5, 8.0), (D("2024-01-02"), 1.0, 2.0, None, 9.0)]


def test_json_dimension_files(spark, rows, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"W1": "north", "W2": "north"}, indent=4))
    (tmp_path / "info.json").write_text(
        json.dumps({"north": {"city": "Town", "latitude": 1.5, "longitude": 2.5}}, indent=4))
    codes = readers.branch_map_from_json(readers.json_documents(spark, f"{tmp_path}/map.json"))
    assert rows(codes) == [("W1", "north"), ("W2", "north")]
    places = readers.branch_dim_from_json(readers.json_documents(spark, f"{tmp_path}/info.json"))
    assert rows(places) == [("north", "Town", 1.5, 2.5)]


def test_csv_round_trip(spark, rows):
    path = run_dir(spark, "test-csv")
    df = spark.createDataFrame(
        [(D("2024-01-01"), 3, 'rich, "dark"', "north", "cakes")], schemas.FORECAST)
    readers.write_csv(df, path)
    assert rows(readers.read_csv(spark, path, schemas.FORECAST)) == rows(df)


@pytest.mark.parametrize(
    "start, end, expected",
    [
        ("2024-03-01", "2024-04-30", "2024-03-01"),  # 60 days
        ("2024-01-31", "2024-04-30", "2024-02-29"),
        ("2024-04-30", "2024-04-30", "2024-04-30"),
    ],
)
def test_clamped_range(spark, start, end, expected):
    clamped = calendar.clamp_start(F.lit(D(start)), F.lit(D(end)))
    assert spark.range(1).select(clamped).first()[0] == D(expected)


def test_rounding_and_division(spark):
    df = spark.createDataFrame([(0.5, 0.0), (1.5, 2.0), (2.5, None)], "a double, b double")
    assert [r[0] for r in df.select(numeric.half_even_int(F.col("a"))).collect()] == [0, 2, 2]
    assert [r[0] for r in df.select(numeric.ratio(F.col("a"), F.col("b"))).collect()] == [
        None, 0.75, None]


def test_week_and_month_bounds(spark):
    day = F.lit(D("2024-02-11"))  # a Sunday
    got = spark.range(1).select(*calendar.week_bounds(day), *calendar.month_bounds(day)).first()
    assert list(got) == [D("2024-02-05"), D("2024-02-11"), D("2024-02-01"), D("2024-02-29")]


def test_name_and_question_normal_forms(spark):
    df = spark.createDataFrame([("  Carrot (Cup Cakes) ", " How\tMANY\n are  there ")],
                               "n string, q string")
    got = df.select(text.normalize_name(F.col("n")), text.normalize_question(F.col("q"))).first()
    assert list(got) == ["carrot cup cakes", "how many are there"]


def test_keywords_are_whole_words_in_any_case(spark):
    words = ["please Drop it", "droplet", "ADD", "added", "add, then", "éadd", "del", "model"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    flags = [r[0] for r in df.select(text.has_restricted_keyword(F.col("t"))).collect()]
    assert flags == [True, False, True, False, True, False, True, False]


def test_scores(spark):
    df = spark.createDataFrame(
        [({"A": 0.6},), ({"A": 0.1, "B": 0.61},), ({},), (None,), ({"A": None},)],
        "s map<string, double>")
    flags = [r[0] for r in df.select(text.has_high_score(F.col("s"))).collect()]
    assert flags == [False, True, False, False, False]


SALES = [
    (D("2024-01-01"), "north", "cakes", "Nutella", 1.0),
    (D("2024-01-02"), "south", "cakes", "plain", 2.0),
    (D("2024-01-03"), "Canal road", "pies", None, 3.0),
    (D("2024-02-14"), "north", "pies", "White Chocolate ", 4.0),
    (D("2024-02-15"), "north", "pies", "White Chocolate", 5.0),
]


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(SALES, schemas.SALES)


def quantities(df):
    return sorted(r["qty_sold"] for r in df.select("qty_sold").collect())


def test_exclusions_keep_nulls_and_compare_as_stated(spark, sales):
    assert quantities(selection.exclude_items(sales)) == [2.0, 3.0, 5.0]
    assert quantities(selection.exclude_items(sales, trimmed=True)) == [2.0, 3.0]
    assert quantities(selection.exclude_branches(sales)) == [1.0, 2.0, 4.0, 5.0]
    assert quantities(selection.exclude_dates(sales)) == [2.0, 3.0, 5.0]  # 1 January is out too
    table = spark.createDataFrame([("plain",)], "item_name string")
    assert quantities(selection.exclude(sales, "item_name", table)) == [1.0, 3.0, 4.0, 5.0]


def test_selection_rules(spark, sales):
    all_items = ["Nutella", "plain", "White Chocolate"]
    groups, branches = ["cakes", "pies"], ["north", "south"]
    args = (branches, groups)
    count = lambda df: df.count()
    ranged = selection.sales_history(sales, *args, all_items, "2024-01-01", "2024-01-02")
    assert count(ranged) == 2
    assert count(selection.sales_history(sales, *args, all_items, day="2024-01-02")) == 1
    assert count(selection.sales_history(sales, *args, [], day="2024-01-02")) == 0
    with pytest.raises(ValueError):
        selection.sales_history(sales, *args, all_items, start="2024-01-01")
    forecast = sales.withColumnRenamed("qty_sold", "prediction")
    assert count(selection.weekly_forecast_view(forecast, [])) == 0
    assert count(selection.weekly_forecast_view(forecast, ["pies"])) == 3
    assert count(selection.weekly_forecast_view(forecast, ["pies"], branches=["north"])) == 2
    assert count(selection.weekly_forecast_view(forecast, ["cakes"], items=["plain"])) == 1
    assert count(selection.branch_sales(sales, "north", [])) == 3
    table = spark.createDataFrame([("plain",), ("plain",)], "item_name string")
    assert count(selection.choose(sales, "item_name", table)) == 1
