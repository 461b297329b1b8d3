"""Series split, model, evaluation and today's view on small frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.operators import evaluate, forecast, reports, stock, today
from tillcast.plans.forecasting import refresh_forecast
from tillcast.session import run_dir
from tillcast.sources import schemas

D = dt.date.fromisoformat
ENRICHED = (
    schemas.SALES
    + ", day string, is_weekend boolean, temperature_2m_max double, temperature_2m_min double"
)


def series(branch, item, quantities, start="2023-05-01", temperature=None):
    first = D(start)
    found = []
    for n, quantity in enumerate(quantities):
        date = first + dt.timedelta(days=n)
        warm = temperature(n) if temperature else 20.0
        found.append((date, branch, "cakes", item, quantity, date.strftime("%A"),
                      date.weekday() >= 5, warm, 10.0))
    return found


def frame(spark, *parts):
    return spark.createDataFrame([row for part in parts for row in part], ENRICHED)


def test_series_of_7_8_and_9_rows(spark, rows):
    df = frame(spark, *[series("n", f"i{k}", [float(1 + j % 3) for j in range(k)])
                        for k in (7, 8, 9)])
    split = forecast.split_series(df)
    assert rows(split.groupBy("item_name", "part").count()) == [
        ("i8", "test", 7), ("i8", "train", 1), ("i9", "test", 7), ("i9", "train", 2)]
    assert rows(forecast.eligible_series(forecast.train_part(split))) == [("n", "i9", 2, 2)]
    ahead = forecast.forecast_forward(df)
    assert rows(ahead, "item_name", "date") == [
        ("i9", D("2023-05-10") + dt.timedelta(days=k)) for k in range(7)]


def test_split_partitions_the_eligible_rows(spark):
    df = frame(spark, series("n", "a", [1.0] * 20), series("s", "a", [2.0] * 5))
    split = forecast.split_series(df)
    assert split.count() == 20
    assert forecast.test_part(split).count() == 7


def test_mode_takes_the_smallest_on_ties(spark, rows):
    df = frame(spark, series("n", "a", [3.0, 1.0, 3.0, 1.0, 2.0]))
    assert rows(forecast.series_cap(df)) == [("n", "a", 1.0)]


def test_weekday_pattern_is_learned(spark, rows):
    week = [10.0, 10.0, 10.0, 10.0, 10.0, 30.0, 30.0]
    df = frame(spark, series("n", "a", week * 8))
    ahead = forecast.forecast_forward(df, regressors=[])
    assert [r[1] for r in rows(ahead, "date", "prediction")] == [10, 10, 10, 10, 10, 30, 30]


def test_regressor_is_learned_and_constant_one_ignored(spark):
    """The quantity follows the temperature; a hot test day must be predicted higher."""
    def warm(n):
        return float((n * 7919) % 31)

    quantities = [50.0 + 2 * warm(n) for n in range(120)]
    df = frame(spark, series("n", "a", quantities, temperature=warm))
    plain = evaluate.mase(evaluate.match(forecast.forecast_backtest(df, regressors=[]), df))
    full = evaluate.mase(evaluate.match(forecast.forecast_backtest(df), df))
    assert full.first()["mae"] < plain.first()["mae"] / 2
    model = forecast.fit(forecast.by_series(forecast.training_set(df))).first()
    assert model["regressor_slope"][2] == 0.0  # the other temperature never changes


def joint_fit(days, quantities, values, feasts):
    """The model of one series by dense least squares: growth, rate and weights of standard terms."""
    y, days = np.array(quantities), np.array(days)
    numbers = np.array([4 * d.year + (d.month + 2) // 3 for d in days])
    t = (numbers - numbers.min()) / 4
    angle = np.array([d.weekday() for d in days]) * 2 * np.pi / 7
    week = [f(k * angle) for k in (1, 2, 3) for f in (np.sin, np.cos)]
    spread = [(v - v.mean()) / v.std() if v.std() > 1e-6 else 0 * v for v in values]
    z = np.stack([np.ones(len(y)), *week, *feasts, *spread], axis=1)
    counts = {q: quantities.count(q) for q in quantities}
    cap = min(counts, key=lambda q: (-counts[q], q))
    now = np.zeros(2)
    for _ in range(forecast.ROUNDS):
        share = 1 / (1 + np.exp(-(now[0] + now[1] * t)))
        slope = cap * share * (1 - share)
        x = np.column_stack([slope, slope * t, z])
        right = x.T @ (y - cap * share) - forecast.RIDGE * np.r_[now, np.zeros(z.shape[1])]
        change = np.linalg.solve(x.T @ x + forecast.RIDGE * np.eye(x.shape[1]), right)[:2]
        now = now + np.clip(change, -forecast.STEP, forecast.STEP)
    share = 1 / (1 + np.exp(-(now[0] + now[1] * t)))
    ridge = forecast.RIDGE * np.eye(z.shape[1])
    return cap, now, np.linalg.solve(z.T @ z + ridge, z.T @ (y - cap * share))


@pytest.mark.parametrize("seed", [1, 2])
def test_joint_fit_equals_a_dense_solve_of_each_series(spark, seed):
    """Growth, week, holidays and regressors are fitted at once, whatever their correlation."""
    random = np.random.default_rng(seed)
    parts, expected = [], {}
    holiday_days = {D("2023-05-01") + dt.timedelta(days=31 * k): "ab"[k % 2] for k in range(16)}
    for item, size in (("long", 480), ("short", 12), ("odd", 95)):
        warm = 20 + 10 * random.standard_normal(size)
        grown = 30 / (1 + np.exp(-np.arange(size) / 90))
        quantities = [float(q) for q in np.round(grown + 0.3 * warm + random.integers(0, 9, size))]
        rows = series("n", item, quantities, temperature=lambda n, w=warm: float(w[n]))
        parts.append(rows)
        days = [r[0] for r in rows]
        values = [np.array([float(r[6]) for r in rows]), warm, np.full(size, 10.0),
                  np.array([float(d.day) for d in days])]
        feasts = [np.array([float(holiday_days.get(d) == name) for d in days]) for name in "ab"]
        expected[item] = joint_fit(days, quantities, values, feasts)
    holidays = spark.createDataFrame(list(holiday_days.items()), "date date, holiday string")
    training = frame(spark, *parts).withColumn("day", F.dayofmonth("date"))
    found = {r["item_name"]: r for r in forecast.fit(training, holidays=holidays).collect()}
    assert set(found) == set(expected)
    for item, (cap, growth, weights) in expected.items():
        got = found[item]
        assert got["cap"] == cap
        assert [got["growth"], got["rate"]] == pytest.approx(list(growth), abs=1e-7)
        assert got["weights"] == pytest.approx(list(weights), abs=1e-6)


def test_forecast_shuffles_rows_at_most_three_times(spark):
    df = frame(spark, series("n", "a", [1.0] * 20))
    plan = forecast.forecast_forward(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "Python" not in plan


def test_only_the_chosen_series_are_fitted(spark, rows):
    df = frame(spark, series("n", "a", [1.0, 3.0] * 10), series("s", "a", [2.0] * 20))
    ahead = forecast.forecast_forward(df, only=lambda r: r.filter("branch = 's'"))
    whole = forecast.forecast_forward(df)
    assert rows(ahead) == rows(whole.filter("branch = 's'")) and ahead.count() == 7


def test_too_many_holidays_are_refused(spark):
    df = frame(spark, series("n", "a", [1.0] * 20))
    many = spark.createDataFrame(
        [(D("2023-05-01"), f"h{k}") for k in range(forecast.MOST_HOLIDAYS + 1)],
        "date date, holiday string")
    with pytest.raises(ValueError):
        forecast.fit(df, [], many)


def test_holiday_effect(spark, rows):
    quantities = [10.0] * 60
    for n in (5, 16, 31):
        quantities[n] = 40.0
    df = frame(spark, series("n", "a", quantities))
    first = D("2023-05-01")
    holidays = spark.createDataFrame(
        [(first + dt.timedelta(days=n), "feast") for n in (5, 16, 31, 62)],
        "date date, holiday string")
    ahead = forecast.forecast_forward(df, regressors=[], holidays=holidays)
    predicted = [r[1] for r in rows(ahead, "date", "prediction")]
    assert predicted[2] > 25 and max(predicted[:2] + predicted[3:]) < 20  # 2 July


def test_short_flat_and_single_weekday_series_stay_within_the_cap(spark):
    df = frame(spark, series("n", "flat", [4.0] * 30), series("n", "drop", [30.0, 2.0] + [1.0] * 9))
    ahead = forecast.forecast_forward(df)
    assert {r["prediction"] for r in ahead.filter("item_name = 'flat'").collect()} == {4}
    assert ahead.agg(F.min("prediction")).first()[0] >= 0


def test_future_frame_is_history_plus_seven_days(spark, rows):
    df = frame(spark, series("n", "a", [1.0] * 10), series("s", "b", [2.0] * 4))
    training = forecast.training_set(df)
    got = forecast.future_frame(training)
    assert got.count() == training.filter("item_name = 'a'").count() + 7
    assert got.filter("date > '2023-05-10'").select("temperature_2m_max").distinct().count() == 1


def test_coming_days_take_the_weather_of_their_branch(spark, rows):
    df = frame(spark, series("n", "a", [1.0] * 10))
    last = df.agg(F.max("date")).first()[0]
    known = [("n", last + dt.timedelta(days=1), 41.0, 11.0), ("s", last + dt.timedelta(days=2), 99.0, 9.0)]
    weather = spark.createDataFrame(
        known, "branch string, date date, temperature_2m_max double, temperature_2m_min double")
    training = forecast.training_set(df)
    mean = training.agg(F.avg("temperature_2m_max")).first()[0]
    got = forecast.future_frame(training, weather=weather).filter(F.col("date") > F.lit(last))
    assert [r[0] for r in got.orderBy("date").select("temperature_2m_max").collect()] == pytest.approx(
        [41.0] + [mean] * 6)


def matched(spark, data):
    return spark.createDataFrame(
        data, "date date, item_name string, branch string, item_group string, prediction int, "
        "qty_sold double, absolute_error double")


def test_errors_need_both_sides(spark, rows):
    key = (D("2024-01-01"), "a", "n", "g")
    predicted = spark.createDataFrame(
        [(key[0], 3, "a", "n", "g"), (key[0], None, "b", "n", "g"), (key[0], 1, "c", "n", "g")],
        schemas.FORECAST)
    actual = spark.createDataFrame(
        [(key[0], "n", "g", "a", 5.0), (key[0], "n", "g", "b", 5.0), (key[0], "n", "g", "c", None)],
        schemas.SALES)
    got = evaluate.match(predicted, actual)
    assert rows(got, "item_name", "absolute_error") == [("a", 2.0)]


def test_naive_error_stays_within_a_series(spark, rows):
    data = [(D(f"2024-01-0{k + 1}"), item, "n", "g", 0, q, 0.0)
            for item, qs in {"a": [1.0, 4.0], "b": [100.0, 98.0]}.items()
            for k, q in enumerate(qs)]
    got = evaluate.with_naive_error(matched(spark, data))
    assert rows(got, "item_name", "naive_error") == [
        ("a", 3.0), ("a", None), ("b", 2.0), ("b", None)]


def test_flat_series_has_no_mase_and_zero_sales_no_relative_error(spark):
    data = [(D(f"2024-01-0{k}"), "a", "n", "g", 2, 0.0, 2.0) for k in (1, 2, 3)]
    df = matched(spark, data)
    assert tuple(evaluate.mase(df).first()) == (2.0, 0.0, None)
    assert {r["relative_error"] for r in evaluate.with_relative_error(df).collect()} == {None}
    scored = evaluate.with_zscore(df)
    assert {r["zscore"] for r in scored.collect()} == {None}
    assert evaluate.bucket_counts(scored).count() == 0


def test_buckets_partition_the_scored_rows(spark, rows):
    data = [(D("2024-01-01"), f"i{k}", "n", "g", 0, 1.0, float(e))
            for k, e in enumerate([0, 10, 10, 10, 10, 10, 30])]
    counts = dict(rows(evaluate.bucket_counts(evaluate.with_zscore(matched(spark, data)))))
    assert counts == {"z < -1": 1, "-1 <= z <= 1": 5, "z > 1": 1}
    assert evaluate.bucket_rows(evaluate.with_zscore(matched(spark, data))).count() == 7


def test_melt(spark, rows):
    df = matched(spark, [(D("2024-01-01"), "a", "n", "g", 3, 5.0, 2.0)])
    assert rows(evaluate.melt(df), "Metric", "Value") == [
        ("Model Prediction", 3.0), ("Quantity Sold", 5.0)]


def test_gate_serves_the_stored_forecast(spark, rows):
    path = run_dir(spark, "test-gate")
    df = frame(spark, series("n", "a", [5.0] * 20))
    first = rows(refresh_forecast(spark, True, df, path))
    other = frame(spark, series("n", "a", [50.0] * 20))
    assert rows(refresh_forecast(spark, False, other, path)) == first
    assert rows(refresh_forecast(spark, True, other, path)) != first


@pytest.fixture
def stock_tables(spark):
    ledger = spark.createDataFrame(
        [("W1", 1, D("2024-01-02"), 9.9, 1), ("W1", 1, D("2024-01-02"), 4.5, 1),
         ("W2", 1, D("2024-01-02"), 7.0, 1), ("W2", 1, D("2024-01-02"), 1.0, 0),
         ("W2", 2, D("2024-01-02"), -2.5, 1), ("W3", 1, D("2024-01-01"), None, 1)],
        "warehouse string, item_code int, posting_date date, qty_after_transaction double, "
        "docstatus int")
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item_code int, item_name string")
    codes = spark.createDataFrame(
        [("W1", "north"), ("W2", "north"), ("W3", "south")], "code string, branch string")
    return ledger, items, codes


def test_minimum_balance(stock_tables, rows):
    got = stock.minimum_balance(*stock_tables, ["NORTH"], ["a", "b"], "2024-01-02")
    assert rows(got, "branch", "item_name", "balance") == [
        ("north", "a", 4), ("north", "a", 7), ("north", "b", -2)]
    nothing = stock.minimum_balance(*stock_tables, ["south"], ["a"], "2024-01-01", "2024-01-31")
    assert rows(nothing, "balance") == [(None,)]


def test_unknown_names_of_a_choice_are_told(stock_tables, rows):
    ledger, items, codes = stock_tables
    choice = ["North", "west"], ["a", "c", "c"]
    found, problems = stock.checked(stock.minimum_balance, ledger, items, codes, *choice, "2024-01-02")
    assert rows(found, "item_name", "balance") == [("a", 4), ("a", 7)]
    assert rows(problems, "kind", "name") == [("branch", "west"), ("item", "c")]
    nothing, sound = stock.checked(stock.balance_today, ledger, items, codes, ["south"], ["b"], "2024-01-02")
    assert nothing.count() == 0 and sound.count() == 0
    assert stock.unknown_choice(items, codes, None, None).count() == 0


def test_balance_view_shortens_long_ranges(spark, stock_tables, rows):
    got = stock.balance_view(*stock_tables, ["north", "south"], ["a"], "2023-01-01", "2024-03-02")
    assert rows(got, "Branch", "Date") == [("north", D("2024-01-02")), ("north", D("2024-01-02"))]


def test_price_is_the_highest_half_to_even(spark, rows):
    prices = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("b", 3.5)],
                                   "item_name string, price_list_rate double")
    assert rows(stock.price_list(prices)) == [("a", 2), ("b", 4)]


def test_today_with_and_without_stock(spark, stock_tables, rows):
    sales = spark.createDataFrame(
        [(D("2024-01-01"), "north", "g", "a", 5.0), (D("2024-01-01"), "north", "g", "Nutella", 5.0),
         (D("2023-12-31"), "north", "g", "b", 5.0)], schemas.SALES)
    planned = spark.createDataFrame(
        [(D("2024-01-02"), 6, "a", "north", "g"), (D("2024-01-02"), 3, "b", "north", "g")],
        schemas.FORECAST)
    in_hand = stock.balance_today(*stock_tables, ["north"], ["a", "b"], "2024-01-02")
    choice = (["north"], ["a", "b", "Nutella"], ["g"])
    shown = ("item_name", "previous_day_sales", "today_forecast", "quantity_present_in_branch")
    got = today.today_forecast(sales, planned, in_hand, "2024-01-02", *choice)
    assert rows(got, *shown) == [("a", 5.0, 6, 11.5)]
    full = today.today_forecast(sales, planned, in_hand, "2024-01-02", *choice, keep_unsold=True)
    assert rows(full, *shown) == [("a", 5.0, 6, 11.5), ("b", None, 3, -2.5)]
    empty = today.today_forecast(sales, planned, in_hand.filter("false"), "2024-01-02", *choice)
    assert rows(empty, *shown) == [("a", 5.0, 6, None)]


def test_group_without_rows_counts_zero(spark, rows):
    sales = spark.createDataFrame([(D("2024-01-01"), "n", "cakes", "a", 2.0)], schemas.SALES)
    assert rows(reports.group_summary(sales, ["cakes", "pies"])) == [
        ("cakes", 2.0, 1), ("pies", 0.0, 0)]


def test_ties_go_by_name(spark, rows):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "branch string, qty_sold double")
    assert [r["branch"] for r in reports.ranked(df, ["branch"], 2).collect()] == ["c", "a"]
    assert [r["branch"] for r in reports.ranked(df, ["branch"], 2, top=False).collect()] == ["a", "b"]
