"""Incremental refresh of the stored sales fact, bare or enriched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators import rollup
from tillcast.operators.enrich import enrich_sales
from tillcast.sources.enriched_store import EnrichedStore
from tillcast.sources.fact_store import MONTH, FactStore


def refresh(invoice_items: DataFrame, branch_map: DataFrame, store: FactStore) -> bool:
    """Roll up the lines since the stored high-water mark and replace the touched months.

    Branch names are mapped before the merge, so stored and new rows meet on equal keys and
    the new row wins. Only the months the new rows span are read, merged and written. Without a
    store everything is rolled up; without new rows nothing is written and False returned.
    """
    store.recover()
    stored = store.read_if_exists()
    mark = None if stored is None else store.high_water_mark(stored)
    if mark is None:
        store.create(rollup.sales_daily(invoice_items, branch_map))
        return True
    recent = rollup.since_mark(invoice_items, mark)
    month = F.date_format("creation", "yyyy-MM")
    first_month, last_month = recent.select(F.min(month), F.max(month)).first()
    if first_month is None:
        return False
    batch = rollup.sales_daily(recent, branch_map)
    touched = stored.filter(F.col(MONTH).between(first_month, last_month)).drop(MONTH)
    store.replace_months(rollup.upsert_last(touched, batch))
    return True


def refresh_enriched(
    invoice_items: DataFrame,
    branch_map: DataFrame,
    branch_dim: DataFrame,
    weather: DataFrame,
    store: EnrichedStore,
) -> bool:
    """The same for the store of enriched sales and their statistics.

    Only the new rows are enriched: the weather is read for the days since the mark. Stored rows of
    the touched months are kept as they are, and the statistics of these months alone are made anew.

    A first load lays the sums out by month before they are enriched, so that what the rows gain is
    not shuffled with them. That layout holds where Spark broadcasts the places and the weather, as
    it does below its threshold; above it their joins deal the rows anew, to more files a month.
    """
    store.recover()
    if not store.exists():
        sales = store.facts.by_month(rollup.sales_daily(invoice_items, branch_map))
        store.create(enrich_sales(sales, branch_dim, weather), by_month=True)
        return True
    stored = store.facts.read()
    mark = store.facts.high_water_mark(stored)
    recent = invoice_items if mark is None else rollup.since_mark(invoice_items, mark)
    month = F.date_format("creation", "yyyy-MM")
    first_month, last_month = recent.select(F.min(month), F.max(month)).first()
    if first_month is None:
        return False
    sales = rollup.sales_daily(recent, branch_map)
    days = weather.filter(F.col("date") >= F.lit(f"{first_month}-01").cast("date"))
    batch = enrich_sales(sales, branch_dim, days)
    touched = stored.filter(F.col(MONTH).between(first_month, last_month)).drop(MONTH)
    store.replace_months(rollup.upsert_last(touched, batch))
    return True
