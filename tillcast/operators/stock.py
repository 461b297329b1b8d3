"""Stock balances and prices."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions import calendar, numeric
from tillcast.operators.lookup import (
    codes_of_branches,
    distinct_names,
    map_branches_counted,
    unknown_branches,
)
from tillcast.operators.selection import Selection, choose

#: Tasks that a month's moves are dealt to at most.
MOVE_SLICES = 16
NO_WAREHOUSE, NO_ITEM = "no warehouse of this branch", "no item of this name"


def _chosen_entries(
    ledger: DataFrame,
    items: DataFrame,
    branch_map: DataFrame,
    branches: Sequence[str] | None,
    names: Selection,
    start: Column,
    end: Column,
) -> DataFrame:
    """Submitted ledger entries of the chosen branches and items within a closed range.

    Without a choice of branches all warehouses count, those without a branch under their code. Equal
    rows of the map count once, as the views ask for lowest balances only.
    """
    submitted = ledger.filter(
        (F.col("docstatus") == 1) & F.col("posting_date").between(start, end)
    )
    wanted = choose(items, "item_name", names).select("item_code", "item_name")
    entries = submitted.join(wanted, "item_code")
    if branches is None:
        named = map_branches_counted(entries.withColumn("code", F.col("warehouse")), branch_map, "code")
        return named.drop("copies")
    codes = distinct_names(codes_of_branches(branch_map, branches)).drop("copies").withColumnRenamed("code", "warehouse")
    return entries.join(codes, "warehouse")


def _date(value: date | str | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("date")


def month_moves(moves: DataFrame) -> DataFrame:
    """What left each warehouse of each item in a month: rows (month, keys, moved) of a table of moves
    (date, warehouse_key, item_code, moved). Months merge by sum.

    A warehouse seldom moves an item twice in a month, so sums before the shuffle would save nothing.
    Moves are dealt by month and a slice of the warehouses instead, which is how they are stored."""
    slices = F.pmod(F.hash("warehouse_key"), F.lit(MOVE_SLICES)).alias("slice")
    dealt = moves.select(
        F.date_format("date", "yyyy-MM").alias("month"), slices, "warehouse_key", "item_code", "moved"
    ).repartition("month", "slice")
    sums = dealt.groupBy("month", "slice", "warehouse_key", "item_code").agg(F.sum("moved").alias("moved"))
    return sums.drop("slice")


def moved_before(months: DataFrame, day: date, keys: DataFrame | None = None) -> DataFrame:
    """(warehouse_key, item_code, moved_before): sums of the months before that of ``day``; of the
    warehouses and items among ``keys`` only, if these are given."""
    earlier = months.filter(F.col("month") < f"{day:%Y-%m}")
    if keys is not None:
        wanted = keys.select("warehouse_key", "item_code")
        earlier = earlier.join(wanted, ["warehouse_key", "item_code"], "left_semi")
    return earlier.groupBy("warehouse_key", "item_code").agg(F.sum("moved").alias("moved_before"))


def unknown_choice(
    items: DataFrame,
    branch_map: DataFrame,
    branches: Sequence[str] | None,
    names: Sequence[str] | None,
) -> DataFrame:
    """(kind, name, reason) of the chosen names that a stock view has no rows for because it doesn't
    know them: branches without a warehouse, compared without case, and items not in the list.

    Only distinct known names meet the choice. An empty result says that the choice is sound, so an
    empty view then means that nothing moved."""
    spark = items.sparkSession

    def chosen(given: Sequence[str] | None) -> DataFrame:
        return spark.createDataFrame([(n,) for n in dict.fromkeys(given or [])], "name string")

    unknown = unknown_branches(chosen(branches).withColumnRenamed("name", "branch"), branch_map)
    missing = chosen(names).join(
        items.select(F.col("item_name").alias("name")).distinct(), "name", "left_anti"
    )
    return unknown.select(
        F.lit("branch").alias("kind"), F.col("branch").alias("name"), F.lit(NO_WAREHOUSE).alias("reason")
    ).unionByName(missing.select(F.lit("item").alias("kind"), "name", F.lit(NO_ITEM).alias("reason")))


def checked(
    view: Callable[..., DataFrame],
    ledger: DataFrame,
    items: DataFrame,
    branch_map: DataFrame,
    branches: Sequence[str] | None,
    names: Sequence[str] | None,
    *when: date | str | Column,
) -> tuple[DataFrame, DataFrame]:
    """Any of the stock views, and beside it what ``unknown_choice`` says of its choice."""
    found = view(ledger, items, branch_map, branches, names, *when)
    return found, unknown_choice(items, branch_map, branches, names)


def minimum_balance(
    ledger: DataFrame,
    items: DataFrame,
    branch_map: DataFrame,
    branches: Sequence[str] | None,
    names: Selection,
    start: date | str | Column,
    end: date | str | Column | None = None,
) -> DataFrame:
    """Lowest balance of each warehouse, item and day, under the branch's name.

    ``end`` may be left out for a single day; pass the as-of date as ``start`` for today.
    """
    last = _date(start if end is None else end)
    entries = _chosen_entries(ledger, items, branch_map, branches, names, _date(start), last)
    return (
        entries.groupBy("warehouse", "branch", "item_name", "posting_date")
        .agg(F.min("qty_after_transaction").alias("balance"))
        .select("branch", "item_name", "posting_date", F.col("balance").cast("int"))
    )


def balance_today(
    ledger: DataFrame,
    items: DataFrame,
    branch_map: DataFrame,
    branches: Sequence[str] | None,
    names: Selection,
    as_of: date | str | Column,
) -> DataFrame:
    """Lowest balance of the as-of day per warehouse and item, under the branch's name."""
    today = _date(as_of)
    entries = _chosen_entries(ledger, items, branch_map, branches, names, today, today)
    return (
        entries.groupBy("warehouse", "branch", "item_name")
        .agg(F.min("qty_after_transaction").alias("quantity_present_in_branch"))
        .drop("warehouse")
    )


def balance_view(
    ledger: DataFrame,
    items: DataFrame,
    branch_map: DataFrame,
    branches: Sequence[str] | None,
    names: Selection,
    start: date | str,
    end: date | str,
) -> DataFrame:
    """Balances of a range, shortened to two months when it is longer than 60 days."""
    clamped = calendar.clamp_start(_date(start), _date(end))
    found = minimum_balance(ledger, items, branch_map, branches, names, clamped, end)
    return found.select(
        F.col("item_name").alias("Item"),
        F.col("branch").alias("Branch"),
        F.col("posting_date").alias("Date"),
        F.col("balance").alias("Balance"),
    )


def price_list(prices: DataFrame) -> DataFrame:
    """Highest rate of each item, rounded half to even."""
    return prices.groupBy("item_name").agg(
        numeric.half_even_int(F.max("price_list_rate")).alias("takeaway_price")
    )
