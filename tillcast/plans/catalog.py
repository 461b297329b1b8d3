"""Every registered query: a callable of (session, data folder) that returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions import calendar, text
from tillcast.operators import (
    ask,
    enrich,
    evaluate,
    forecast,
    linking,
    lookup,
    reports,
    rollup,
    selection,
    stock,
    today,
)
from tillcast.plans.forecasting import refresh_forecast
from tillcast.plans.ingest import refresh, refresh_enriched
from tillcast.session import materialize, run_dir
from tillcast.sources import readers, schemas
from tillcast.sources.driver_tables import TABLES, DriverTables
from tillcast.sources.enriched_store import EnrichedStore
from tillcast.sources.fact_store import FactStore
from tillcast.streaming import daily_rollup as stream
from tillcast.streaming import sales_stream

Query = Callable[[SparkSession, str], DataFrame]

# What a user would pick on the report pages.
BRANCH = "nation_9"
BRANCHES = ["nation_9", "nation_6", "nation_11"]
GROUPS = ["PROMO", "SMALL", "MEDIUM"]
GROUPS_WITH_UNKNOWN = ["PROMO", "SMALL", "COOKIES"]
ITEMS = ["red ring", "blue bolt", "old plate", "new gizmo"]
ITEM = "red ring"
RANGE = ("1998-01-01", "1998-12-31")
LONG_RANGE = ("1998-01-01", "1998-04-30")
DAY = "2001-01-12"
YEAR = 1998
CUT = date(2000, 6, 15)
HELD_BACK_LINE = 7
NOTHING_BEFORE = "1900-01-01"
ARRIVALS = ["1900-01-01", "1998-01-01", "2000-03-15", "2100-01-01"]

QUERIES: dict[str, Query] = {}


def query(function: Callable[[DriverTables], DataFrame]) -> Callable[[DriverTables], DataFrame]:
    QUERIES[function.__name__] = lambda spark, root: function(DriverTables(spark, root))
    return function


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Averages rounded for comparison, as sums of doubles depend on their order."""
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- scans and sinks ---------------------------------------------------------------------


@query
def scan_invoice_items(t: DriverTables) -> DataFrame:
    return t.invoice_items().withColumn("creation", F.to_date("creation"))


@query
def csv_roundtrip_forecast(t: DriverTables) -> DataFrame:
    path = run_dir(t.spark, "forecast-csv")
    made = forecast.forecast_forward(t.fact(), weather=t.branch_weather(), means=t.means())
    readers.write_csv(made, path)
    return readers.read_csv(t.spark, path, schemas.FORECAST)


@query
def branch_dim(t: DriverTables) -> DataFrame:
    """Write the dimension as JSON documents of {branch: info}, one a city, and load them."""
    path = run_dir(t.spark, "branch-info")
    entry = F.struct("branch", F.struct("city", "latitude", "longitude"))
    documents = t.branch_dim().groupBy("city").agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")
    )
    documents.write.partitionBy("city").text(path)
    return readers.branch_dim_from_json(readers.json_documents(t.spark, path))


@query
def branch_map(t: DriverTables) -> DataFrame:
    """Documents of {code: branch}, one per code, exploded again."""
    documents = t.branch_map().select(F.to_json(F.create_map("code", "branch")).alias("value"))
    return readers.branch_map_from_json(documents)


@query
def weather_rows(t: DriverTables) -> DataFrame:
    """Service answers of one place and month each, parsed back to a row per day."""
    order = F.array_sort(
        F.collect_list(F.struct("date", "temperature_2m_max", "temperature_2m_min"))
    )
    answers = (
        t.weather()
        .groupBy("latitude", "longitude", F.trunc("date", "MM").alias("month"))
        .agg(order.alias("days"))
    )
    payload = F.struct(
        F.struct(
            F.transform("days", lambda d: d["date"].cast("string")).alias("time"),
            F.col("days.temperature_2m_max").alias("temperature_2m_max"),
            F.col("days.temperature_2m_min").alias("temperature_2m_min"),
        ).alias("daily")
    )
    return readers.weather_from_payload(
        answers.select("latitude", "longitude", F.to_json(payload).alias("payload"))
    )


# --- filters and facets ------------------------------------------------------------------


@query
def filter_range_selection(t: DriverTables) -> DataFrame:
    return selection.select_rows(t.sales(), *RANGE, BRANCHES, GROUPS, ITEMS)


@query
def filter_range_selection_table(t: DriverTables) -> DataFrame:
    """The same with items chosen by a table: those that cost at least 990."""
    dear = t.item_price().filter(F.col("price_list_rate") >= 990).select("item_name").distinct()
    return selection.select_rows(t.sales(), *RANGE, BRANCHES, GROUPS, dear)


@query
def sales_history_range(t: DriverTables) -> DataFrame:
    found = selection.sales_history(t.sales(), BRANCHES, GROUPS, ITEMS, *RANGE)
    return found.withColumnsRenamed({"Quantity Sold": "quantity_sold"})


@query
def sales_history_single_day(t: DriverTables) -> DataFrame:
    items = ["red ring", "small gear", "blue bolt", "old rod", "cold ring", "hot rod", "new plate"]
    found = selection.sales_history(
        t.sales(), BRANCHES, [*GROUPS, "LARGE", "ECONOMY"], items, day="1998-02-28"
    )
    return found.withColumnsRenamed({"Quantity Sold": "quantity_sold"})


@query
def weekly_forecast_view(t: DriverTables) -> DataFrame:
    rows = forecast.forecast_forward(
        t.fact(),
        weather=t.branch_weather(),
        means=t.means(),
        only=lambda rows: selection.choose(rows, "branch", BRANCHES),
    )
    found = selection.weekly_forecast_view(rows, GROUPS, branches=BRANCHES)
    return found.withColumnsRenamed({"Model Prediction": "model_prediction"})


@query
def exclude_items_dates(t: DriverTables) -> DataFrame:
    """Anti filters by list and by table: chosen items, branches and every region-0 branch."""
    sales = selection.exclude(t.sales(), "item_name", ITEMS)
    sales = selection.exclude_dates(sales, [RANGE[0], RANGE[1], DAY])
    first_city = t.branch_dim().filter(F.col("longitude") == 0).select("branch")
    return selection.exclude(sales, "branch", first_city)


@query
def facet_branches(t: DriverTables) -> DataFrame:
    return selection.facet(t.sold_branches(), "branch")


@query
def facet_groups(t: DriverTables) -> DataFrame:
    return selection.facet(t.sold_items(), "item_group")


@query
def facet_items_by_group(t: DriverTables) -> DataFrame:
    return selection.facet(t.sold_items(), "item_name", GROUPS[:1])


@query
def available_range(t: DriverTables) -> DataFrame:
    return selection.available_range(t.sold_days())


@query
def clamp_range(t: DriverTables) -> DataFrame:
    """The range of each branch's and item's sales in a year, clamped to two months."""
    ranges = (
        selection.in_range(t.sales_lines(), *RANGE)
        .groupBy("branch", "item_name")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    )
    start = calendar.clamp_start(F.col("start_date"), F.col("end_date"))
    return ranges.withColumn("clamped_start", start)


# --- lookups and features ----------------------------------------------------------------


@query
def map_branches(t: DriverTables) -> DataFrame:
    return lookup.map_branches(rollup.daily_rollup(t.invoice_items()), t.stored_branch_map())


@query
def map_branches_unknown(t: DriverTables) -> DataFrame:
    """With a map that lacks one branch: its codes pass through."""
    known = t.stored_branch_map().filter(F.col("branch") != BRANCH)
    return lookup.map_branches(rollup.daily_rollup(t.invoice_items()), known)


@query
def unknown_branches(t: DriverTables) -> DataFrame:
    """Chosen names (regions and nations) that are no branch."""
    nations = t.table("nation").select(F.col("n_name").alias("branch"))
    regions = t.table("region").select(F.col("r_name").alias("branch"))
    return lookup.unknown_branches(nations.union(regions), t.stored_branch_map())


@query
def enrich_branch(t: DriverTables) -> DataFrame:
    return lookup.add_branch_info(t.sales(), t.branch_dim())


@query
def enrich_weather(t: DriverTables) -> DataFrame:
    return enrich.add_weather(lookup.add_branch_info(t.sales(), t.branch_dim()), t.stored_weather())


@query
def distinct_locations(t: DriverTables) -> DataFrame:
    return enrich.distinct_locations(lookup.add_branch_info(t.sales(), t.branch_dim()))


@query
def daily_total_window(t: DriverTables) -> DataFrame:
    rows = lookup.map_branches(rollup.daily_rollup(t.invoice_items()), t.stored_branch_map())
    return rollup.with_daily_total(rows)


@query
def calendar_features(t: DriverTables) -> DataFrame:
    return enrich.add_calendar(t.sales())


@query
def encode_day(t: DriverTables) -> DataFrame:
    named = t.sales().withColumn("day", calendar.weekday_name(F.col("date")))
    return enrich.encode_label(named, "day")


@query
def fill_mean_temperature(t: DriverTables) -> DataFrame:
    filled = enrich.fill_mean(t.fact(), enrich.TEMPERATURES)
    return rounded(filled, 4, *enrich.TEMPERATURES)


@query
def ffill_regressor(t: DriverTables) -> DataFrame:
    return enrich.forward_fill(
        t.fact(), "temperature_2m_max", schemas.SERIES_KEY, ["date", "item_group"]
    )


@query
def preprocess(t: DriverTables) -> DataFrame:
    enriched = enrich.preprocess(
        rollup.daily_rollup(t.invoice_items()),
        t.stored_branch_map(),
        t.branch_dim(),
        t.stored_weather(),
    )
    return rounded(enriched, 4, *enrich.TEMPERATURES)


# --- rollups and merges ------------------------------------------------------------------


@query
def daily_rollup(t: DriverTables) -> DataFrame:
    return rollup.daily_rollup(t.invoice_items())


@query
def incremental_rollup(t: DriverTables) -> DataFrame:
    return rollup.incremental_rollup(t.invoice_items(), CUT)


@query
def resum_after_mapping(t: DriverTables) -> DataFrame:
    return rollup.resum(
        lookup.map_branches(rollup.daily_rollup(t.invoice_items()), t.stored_branch_map())
    )


@query
def dedup_first(t: DriverTables) -> DataFrame:
    return rollup.dedup_first(t.sales(), ["branch", "item_name", "date"], ["item_group"])


@query
def ingest_upsert(t: DriverTables) -> DataFrame:
    """Store the sales up to a day, some of that day's lines missing, then refresh.

    The look-back reads the last two stored days again, so the outcome must equal the
    rollup of all lines.
    """
    store = FactStore(t.spark, run_dir(t.spark, "sales"))
    line = t.table("lineitem")
    shipped = F.col("l_shipdate")
    day_of_cut = F.lit(CUT).cast("timestamp_ntz")
    early = line.filter(
        (shipped < day_of_cut)
        | ((shipped == day_of_cut) & (F.col("l_linenumber") != HELD_BACK_LINE))
    )
    first = DriverTables(t.spark, t.root)
    first.table = lambda name: early if name == "lineitem" else t.table(name)
    refresh(first.invoice_items(), t.stored_branch_map(), store)
    refresh(t.invoice_items(), t.stored_branch_map(), store)
    return store.read().drop("month")


def _grown_store(t: DriverTables) -> EnrichedStore:
    """A store loaded up to a day, some of that day's lines missing, and then refreshed."""
    store = EnrichedStore(t.spark, run_dir(t.spark, "enriched"))
    day_of_cut = F.lit(CUT).cast("timestamp_ntz")
    line, shipped = t.table("lineitem"), F.col("l_shipdate")
    missing = (shipped == day_of_cut) & (F.col("l_linenumber") == HELD_BACK_LINE)
    early = line.filter((shipped <= day_of_cut) & ~missing)
    first = DriverTables(t.spark, t.root)
    first.table = lambda name: early if name == "lineitem" else t.table(name)
    for arrived in (first, t):
        refresh_enriched(
            arrived.invoice_items(), t.stored_branch_map(), t.branch_dim(),
            t.stored_weather(), store,
        )
    return store


@query
def enriched_upsert(t: DriverTables) -> DataFrame:
    """The refreshed store must equal the enriched rollup of all lines."""
    return rounded(_grown_store(t).read(), 4, *enrich.TEMPERATURES)


@query
def series_statistics(t: DriverTables) -> DataFrame:
    """Rows, quantities and last day of each series, from the refreshed store's sums."""
    return _grown_store(t).series().drop("print")


@query
def stream_daily_rollup(t: DriverTables) -> DataFrame:
    """Event values as quantities: the stream's totals per day and type."""
    folder = run_dir(t.spark, "stream")
    totals = stream.stream_rollup(
        t.event_stream(), "ts", ["event_type"], F.col("value").cast("decimal(18,2)")
    )
    stream.start(totals, folder).awaitTermination()
    found = stream.current_totals(
        t.spark, folder, "date date, event_type string, qty_sold decimal(28,2)"
    )
    return found.withColumn("qty_sold", F.col("qty_sold").cast("double"))


def _streamed_store(t: DriverTables) -> EnrichedStore:
    """The lines arriving in parts, by day; each run of the stream goes on where the last one ended."""
    store = EnrichedStore(t.spark, run_dir(t.spark, "streamed"))
    folder = run_dir(t.spark, "arriving")
    shipped = F.col("l_shipdate")
    arriving = DriverTables(t.spark, t.root)
    arriving.table = lambda name: (
        t.spark.readStream.schema(TABLES["lineitem"]).parquet(folder)
        if name == "lineitem"
        else t.table(name)
    )
    for first, end in zip(ARRIVALS, ARRIVALS[1:], strict=False):
        part = t.table("lineitem").filter((shipped >= first) & (shipped < end))
        part.write.mode("append").parquet(folder)
        sales_stream.start(
            arriving.invoice_items(), t.stored_branch_map(), t.branch_dim(), t.stored_weather(), store
        ).awaitTermination()
    return store


@query
def stream_sales(t: DriverTables) -> DataFrame:
    """Streamed lines must give the enriched rollup of all lines."""
    return rounded(_streamed_store(t).read(), 4, *enrich.TEMPERATURES)


@query
def stream_ledger(t: DriverTables) -> DataFrame:
    """What each batch of the streamed lines added."""
    return _streamed_store(t).ledger()


# --- totals and rankings -----------------------------------------------------------------


@query
def branch_totals(t: DriverTables) -> DataFrame:
    return reports.branch_totals(t.sold_branches())


@query
def branch_count(t: DriverTables) -> DataFrame:
    return reports.branch_count(t.sold_branches())


@query
def top5_branches(t: DriverTables) -> DataFrame:
    return reports.ranked(reports.branch_totals(t.sold_branches()), ["branch"])


@query
def bottom5_branches(t: DriverTables) -> DataFrame:
    return reports.ranked(reports.branch_totals(t.sold_branches()), ["branch"], top=False)


@query
def group_summary(t: DriverTables) -> DataFrame:
    chosen = selection.branch_sales(t.sales_lines(), BRANCH)
    return reports.group_summary(chosen, GROUPS_WITH_UNKNOWN)


@query
def chart_qty_by_item(t: DriverTables) -> DataFrame:
    return reports.chart_by_item(selection.branch_sales(t.sales_lines(), BRANCH, GROUPS))


@query
def daily_top5(t: DriverTables) -> DataFrame:
    return reports.daily_ranking(selection.branch_sales(t.sales(), BRANCH), DAY)


@query
def daily_bottom5(t: DriverTables) -> DataFrame:
    return reports.daily_ranking(selection.branch_sales(t.sales(), BRANCH), DAY, top=False)


@query
def weekly_top5(t: DriverTables) -> DataFrame:
    return reports.weekly_ranking(selection.branch_sales(t.sales_lines(), BRANCH), DAY)


@query
def weekly_bottom5(t: DriverTables) -> DataFrame:
    return reports.weekly_ranking(selection.branch_sales(t.sales_lines(), BRANCH), DAY, top=False)


@query
def monthly_top5(t: DriverTables) -> DataFrame:
    return reports.monthly_ranking(selection.branch_sales(t.sales_lines(), BRANCH, GROUPS), DAY)


@query
def monthly_bottom5(t: DriverTables) -> DataFrame:
    return reports.monthly_ranking(
        selection.branch_sales(t.sales_lines(), BRANCH, GROUPS), DAY, top=False
    )


# --- forecast ----------------------------------------------------------------------------


def _split(t: DriverTables) -> DataFrame:
    return forecast.split_series(forecast.training_set(t.fact(), t.means()))


@query
def forecast_training_set(t: DriverTables) -> DataFrame:
    return rounded(forecast.training_set(t.fact(), t.means()), 4, *enrich.TEMPERATURES)


@query
def train_test_split(t: DriverTables) -> DataFrame:
    return _split(t).select(*schemas.SALES_KEY, "qty_sold", "part")


@query
def eligible_series(t: DriverTables) -> DataFrame:
    return forecast.eligible_series(forecast.train_part(_split(t)))


@query
def series_cap_mode(t: DriverTables) -> DataFrame:
    return forecast.series_cap(forecast.train_part(_split(t)))


@query
def future_frame(t: DriverTables) -> DataFrame:
    training = forecast.training_set(t.fact(), t.means())
    frame = forecast.future_frame(training, weather=t.branch_weather())
    return rounded(frame, 4, *enrich.TEMPERATURES)


@query
def series_forecast(t: DriverTables) -> DataFrame:
    return forecast.forecast_forward(
        t.fact(), weather=t.branch_weather(), means=t.means()
    )


@query
def series_forecast_trend(t: DriverTables) -> DataFrame:
    """Trend and weekday only."""
    return forecast.forecast_forward(t.fact(), regressors=[], means=t.means())


@query
def series_forecast_holidays(t: DriverTables) -> DataFrame:
    """With the first and last day of every quarter seen in the data as holidays."""
    first = F.col("date") == F.trunc("date", "quarter")
    last = F.date_add("date", 1) == F.trunc(F.date_add("date", 1), "quarter")
    holidays = (
        t.table("lineitem")
        .select(F.to_date("l_shipdate").alias("date"))
        .filter(first | last)
        .distinct()
        .withColumn("holiday", F.when(first, "first day").otherwise("last day"))
    )
    return forecast.forecast_forward(
        t.fact(), holidays=holidays, weather=t.branch_weather(), means=t.means()
    )


@query
def series_backtest(t: DriverTables) -> DataFrame:
    return forecast.forecast_backtest(t.fact(), means=t.means())


@query
def forecast_gate(t: DriverTables) -> DataFrame:
    """A first refresh brings new rows and stores the forecast, a second without serves it."""
    path = run_dir(t.spark, "forecast")
    store = FactStore(t.spark, run_dir(t.spark, "sales"))
    lines = t.invoice_items()
    nothing_new = lines.filter(F.col("creation") < F.lit(NOTHING_BEFORE).cast("timestamp_ntz"))
    served = None
    for arrived in (lines, nothing_new):
        has_new = refresh(arrived, t.stored_branch_map(), store)
        served = refresh_forecast(t.spark, has_new, t.fact(), path, weather=t.branch_weather())
    return served


# --- forecast evaluation -----------------------------------------------------------------


def _matched(t: DriverTables) -> DataFrame:
    fact = t.fact()
    return evaluate.match(forecast.forecast_backtest(fact, means=t.means()), fact)


def _stored_match(t: DriverTables) -> DataFrame:
    """Matched rows as a written table: the z-score reads them for its mean, then again."""
    return materialize(_matched(t), "matched")


@query
def forecast_errors(t: DriverTables) -> DataFrame:
    return _matched(t)


@query
def naive_errors(t: DriverTables) -> DataFrame:
    return evaluate.with_naive_error(_matched(t))


@query
def mase(t: DriverTables) -> DataFrame:
    return rounded(evaluate.mase(_matched(t)), 4, "mae", "naive_mae", "mase")


@query
def relative_error(t: DriverTables) -> DataFrame:
    return rounded(evaluate.with_relative_error(_matched(t)), 4, "relative_error")


@query
def zscore_error(t: DriverTables) -> DataFrame:
    return rounded(evaluate.with_zscore(_stored_match(t)), 4, "zscore")


@query
def zscore_buckets(t: DriverTables) -> DataFrame:
    return evaluate.bucket_counts(evaluate.with_zscore(_stored_match(t)))


@query
def zscore_bucket_rows(t: DriverTables) -> DataFrame:
    rows = evaluate.bucket_rows(evaluate.with_zscore(_stored_match(t)))
    renamed = {
        "Quantity Sold": "quantity_sold",
        "Model Prediction": "model_prediction",
        "Z-Score Error": "zscore_error",
    }
    return rounded(rows.withColumnsRenamed(renamed), 4, "zscore_error")


@query
def melt_actual_vs_forecast(t: DriverTables) -> DataFrame:
    return evaluate.melt(selection.choose(_matched(t), "branch", BRANCHES))


# --- stock, prices, today ----------------------------------------------------------------


@query
def stock_ledger(t: DriverTables) -> DataFrame:
    return t.stock_ledger()


@query
def stock_min_range(t: DriverTables) -> DataFrame:
    capitals = [b.upper() for b in BRANCHES]
    ledger = t.stock_ledger(capitals, ITEMS, RANGE[1], since=RANGE[0])
    return stock.minimum_balance(
        ledger, t.item(), t.stored_branch_map(), capitals, ITEMS, *RANGE
    )


@query
def stock_min_day(t: DriverTables) -> DataFrame:
    ledger = t.stock_ledger(BRANCHES, until=DAY, since=DAY)
    return stock.minimum_balance(ledger, t.item(), t.stored_branch_map(), BRANCHES, None, DAY)


def _in_hand(t: DriverTables) -> DataFrame:
    """Balances of the last day with a line, from that month's lines and the sums of earlier months."""
    day = t.last_day()
    ledger = t.stock_ledger(until=day, since=day)
    return stock.balance_today(ledger, t.item(), t.stored_branch_map(), None, None, day)


@query
def stock_today(t: DriverTables) -> DataFrame:
    return _in_hand(t)


@query
def stock_unknown_choice(t: DriverTables) -> DataFrame:
    """What a stock view says of a choice with names of a region, an item spelt wrong and real ones."""
    branches = [*BRANCHES, "Europe", "NATION_3", "nowhere"]
    items = [*ITEMS, "red rign", "Blue Bolt"]
    return stock.unknown_choice(t.item(), t.stored_branch_map(), branches, items)


@query
def balance_view(t: DriverTables) -> DataFrame:
    start = calendar.clamp_start(F.lit(LONG_RANGE[0]).cast("date"), F.lit(LONG_RANGE[1]).cast("date"))
    since = str(t.spark.range(1).select(start).first()[0])
    ledger = t.stock_ledger(BRANCHES, ITEMS, LONG_RANGE[1], since=since)
    return stock.balance_view(
        ledger, t.item(), t.stored_branch_map(), BRANCHES, ITEMS, *LONG_RANGE
    )


@query
def price_list(t: DriverTables) -> DataFrame:
    return stock.price_list(t.item_price())


@query
def today_forecast(t: DriverTables) -> DataFrame:
    return _today(t, keep_unsold=False)


@query
def today_forecast_full(t: DriverTables) -> DataFrame:
    return _today(t, keep_unsold=True)


def _today(t: DriverTables, keep_unsold: bool) -> DataFrame:
    """Forecast as known on the as-of day: from the sales before it.

    A series has a forecast for the day only if it sold within the horizon before it; without
    unsold items only those of the day before are shown. The others are not fitted.
    """
    fact = t.fact()
    before = fact.filter(F.col("date") < t.as_of())
    days = forecast.HORIZON if keep_unsold else 1
    recent = before.filter(F.col("date") >= F.date_sub(t.as_of(), days))
    active = materialize(recent.select(*schemas.SERIES_KEY).distinct(), "active-series")
    in_hand = _in_hand(t)
    return today.today_forecast(
        fact,
        forecast.forecast_forward(
            before,
            weather=t.branch_weather(),
            only=lambda rows: rows.join(active, schemas.SERIES_KEY, "left_semi"),
        ),
        in_hand,
        t.as_of(),
        None,
        None,
        None,
        keep_unsold,
    )


# --- questions ---------------------------------------------------------------------------


def _ask(t: DriverTables, question: str, **args: str | int) -> DataFrame:
    ask.publish_views(t.sales(), t.balance(args.get("day")), t.item_price())
    return ask.ask(t.spark, question, **args)


@query
def ask_top_branch(t: DriverTables) -> DataFrame:
    return _ask(t, "top_branch")


@query
def ask_group_year_qty(t: DriverTables) -> DataFrame:
    return _ask(t, "group_year_qty", item_group="promo", year=YEAR)


@query
def ask_item_year_avg(t: DriverTables) -> DataFrame:
    return rounded(_ask(t, "item_year_avg", item_name=ITEM, year=YEAR), 4, "avg_qty_sold")


@query
def ask_peak_date(t: DriverTables) -> DataFrame:
    return _ask(t, "peak_date")


@query
def ask_top_group(t: DriverTables) -> DataFrame:
    return _ask(t, "top_group")


@query
def ask_item_branch_week(t: DriverTables) -> DataFrame:
    return _ask(
        t, "item_branch_week", item_name="large plate", branch=BRANCH, month_start="1999-11-01"
    )


@query
def ask_item_branch_day(t: DriverTables) -> DataFrame:
    return _ask(t, "item_branch_day", item_name="large plate", branch=BRANCH, day="1999-11-04")


@query
def ask_group_balance_report(t: DriverTables) -> DataFrame:
    return _ask(t, "group_balance_report", item_group="promo", branch=BRANCH, day="2000-01-27")


@query
def ask_item_balance(t: DriverTables) -> DataFrame:
    return _ask(t, "item_balance", item_name="large plate", branch=BRANCH, day="2000-01-27")


@query
def ask_item_price(t: DriverTables) -> DataFrame:
    return _ask(t, "item_price", item_name=ITEM)


@query
def normalize_names(t: DriverTables) -> DataFrame:
    """Names spelt with capitals, brackets and blanks, and their normal form."""
    raw = F.concat(F.lit("  "), F.initcap("p_name"), F.lit(" ("), "p_brand", F.lit(") "))
    names = t.table("part").select("p_partkey", raw.alias("raw_name"))
    return names.withColumn("item_name", text.normalize_name(F.col("raw_name")))


@query
def catalog_items(t: DriverTables) -> DataFrame:
    """Names of the distinct keys of sales and invoices, and of all prices."""
    tables = t.sold_items(), t.sold_items(t.invoiced_lines()), t.item_price()
    return ask.catalog_items(*(ask.normalize_names(names) for names in tables))


@query
def catalog_branches(t: DriverTables) -> DataFrame:
    return ask.catalog_branches(t.sold_branches(), t.sold_branches(t.invoiced_lines()))


# --- texts -------------------------------------------------------------------------------


def _texts(t: DriverTables) -> DataFrame:
    return t.questions().select("text_id", text.normalize_question(F.col("text")).alias("text"))


def _names(t: DriverTables) -> DataFrame:
    """The names known to sales, balance or prices."""
    items, branches = QUERIES["catalog_items"], QUERIES["catalog_branches"]
    return linking.catalogue(
        items(t.spark, t.root).toDF("name"), branches(t.spark, t.root).toDF("name")
    )


@query
def text_normalize(t: DriverTables) -> DataFrame:
    return _texts(t)


@query
def text_mentions(t: DriverTables) -> DataFrame:
    return linking.text_mentions(materialize(_texts(t), "texts"), _names(t))


@query
def fuzzy_entity_link(t: DriverTables) -> DataFrame:
    texts = materialize(_texts(t), "texts")
    return linking.answer_context(linking.fuzzy_link(texts, _names(t)))


@query
def keyword_screen(t: DriverTables) -> DataFrame:
    return linking.keyword_screen(_texts(t))


@query
def score_screen(t: DriverTables) -> DataFrame:
    return linking.score_screen(t.question_scores())


@query
def answer_route(t: DriverTables) -> DataFrame:
    return linking.route(_texts(t), t.question_scores(), _names(t))
