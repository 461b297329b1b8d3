"""The ad-hoc questions, as SQL over the views ``sales``, ``balance`` and ``price``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions import numeric, text

VOUCHER = "POS Invoice"
ROW_LIMIT = 10  # rows of an answer unless the question asks for another number


def normalize_names(df: DataFrame) -> DataFrame:
    """Item names and groups in the one spelling all three tables are joined on."""
    present = [c for c in ("item_name", "item_group") if c in df.columns]
    return df.withColumns({c: text.normalize_name(F.col(c)) for c in present})


def sales_table(sales: DataFrame) -> DataFrame:
    return normalize_names(
        sales.select("item_name", "branch", "item_group", "date", "qty_sold")
    )


def balance_table(balance: DataFrame) -> DataFrame:
    invoiced = balance.filter(F.col("voucher_type") == VOUCHER)
    return normalize_names(invoiced.select("item_name", "branch", "item_group", "date", "balance"))


def price_table(prices: DataFrame) -> DataFrame:
    """One price per normalised name: the highest, as in the price list."""
    named = normalize_names(prices.select("item_name", "price_list_rate", "currency"))
    return named.groupBy("item_name", "currency").agg(
        numeric.half_even_int(F.max("price_list_rate")).alias("price")
    )


def publish_views(sales: DataFrame, balance: DataFrame, prices: DataFrame) -> None:
    sales_table(sales).createOrReplaceTempView("sales")
    balance_table(balance).createOrReplaceTempView("balance")
    price_table(prices).createOrReplaceTempView("price")


QUESTIONS = {
    "top_branch": """
        SELECT branch, sum(qty_sold) AS qty_sold FROM sales
        GROUP BY branch ORDER BY qty_sold DESC, branch LIMIT 1""",
    "group_year_qty": """
        SELECT sum(qty_sold) AS qty_sold FROM sales
        WHERE item_group = :item_group
          AND date BETWEEN make_date(:year, 1, 1) AND make_date(:year, 12, 31)""",
    "item_year_avg": """
        SELECT avg(qty_sold) AS avg_qty_sold FROM sales
        WHERE item_name = :item_name
          AND date BETWEEN make_date(:year, 1, 1) AND make_date(:year, 12, 31)""",
    "peak_date": """
        SELECT date, sum(qty_sold) AS qty_sold FROM sales
        GROUP BY date ORDER BY qty_sold DESC, date LIMIT 1""",
    "top_group": """
        SELECT item_group, sum(qty_sold) AS qty_sold FROM sales
        GROUP BY item_group ORDER BY qty_sold DESC, item_group LIMIT 1""",
    "item_branch_week": f"""
        SELECT date, item_name, branch, sum(qty_sold) AS qty_sold FROM sales
        WHERE item_name = :item_name AND branch = :branch
          AND date BETWEEN CAST(:month_start AS DATE) AND date_add(CAST(:month_start AS DATE), 6)
        GROUP BY date, item_name, branch ORDER BY date LIMIT {ROW_LIMIT}""",
    "item_branch_day": """
        SELECT item_name, branch, sum(qty_sold) AS qty_sold FROM sales
        WHERE item_name = :item_name AND branch = :branch AND date = CAST(:day AS DATE)
        GROUP BY item_name, branch""",
    "group_balance_report": """
        SELECT item_name, item_group, branch, date, balance FROM balance
        WHERE item_group = :item_group AND branch = :branch AND date = CAST(:day AS DATE)
        ORDER BY item_name""",
    "item_balance": """
        SELECT item_name, branch, date, balance FROM balance
        WHERE item_name = :item_name AND branch = :branch AND date = CAST(:day AS DATE)""",
    "item_price": """
        SELECT item_name, price, currency FROM price WHERE item_name = :item_name""",
}


def ask(spark: SparkSession, question: str, **args: str | int) -> DataFrame:
    """Answer one of ``QUESTIONS`` from the published views."""
    return spark.sql(QUESTIONS[question], args=args)


def catalog_items(sales: DataFrame, balance: DataFrame, prices: DataFrame) -> DataFrame:
    """Every item name known to sales, balance or prices."""
    names = [t.select("item_name").distinct() for t in (sales, balance, prices)]
    return names[0].union(names[1]).union(names[2]).distinct()


def catalog_branches(sales: DataFrame, balance: DataFrame) -> DataFrame:
    names = [t.select("branch").distinct() for t in (sales, balance)]
    return names[0].union(names[1]).distinct()
