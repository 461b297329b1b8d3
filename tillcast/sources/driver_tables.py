"""The domain tables as views over a TPC-H-like star schema.

Each method says which columns stand for which domain column. Nothing is made up: every row
comes from the parquet tables under ``root``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.operators import enrich, lookup, stock
from tillcast.operators.ask import VOUCHER
from tillcast.operators.selection import Selection, choose
from tillcast.plans.ingest import refresh_enriched
from tillcast.session import materialize, run_dir
from tillcast.sources.enriched_store import EnrichedStore
from tillcast.sources.fact_store import FactStore
from tillcast.sources.schemas import SALES_KEY

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

OPENING_STOCK = 5000
MOVES = "warehouse_key bigint, item_code bigint, moved double"
#: Folder of the store of each application and data folder.
_STORES: dict[tuple[str, str], str] = {}


class DriverTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._written: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}.parquet")

    # --- dimensions -----------------------------------------------------------------------

    def branch_map(self) -> DataFrame:
        """Supplier name = warehouse code, nation = branch: several codes per branch."""
        nation = self.table("nation")
        return (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_name").alias("code"), F.lower("n_name").alias("branch"))
        )

    def _once(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        if label not in self._written:
            self._written[label] = materialize(build(), label)
        return self._written[label]

    def stored_branch_map(self) -> DataFrame:
        """The map as the file it is in the field.

        Spark then knows its size and does not shuffle the sales to join it while it is
        small; the size of the join it comes from would be put far too high.
        """
        return self._once("branch-map", self.branch_map)

    def branch_dim(self) -> DataFrame:
        """Region = city; the two keys serve as coordinates."""
        region = self.table("region")
        return (
            self.table("nation")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.lower("n_name").alias("branch"),
                F.col("r_name").alias("city"),
                F.col("n_nationkey").cast("double").alias("latitude"),
                F.col("n_regionkey").cast("double").alias("longitude"),
            )
        )

    def weather(self) -> DataFrame:
        """Highest and lowest order total per day and customer nation, as temperatures."""
        place = self.table("nation").select("n_nationkey", "n_regionkey")
        per_nation = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.to_date("o_orderdate").alias("date"), "c_nationkey")
            .agg(
                F.max("o_totalprice").alias("temperature_2m_max"),
                F.min("o_totalprice").alias("temperature_2m_min"),
            )
        )
        return per_nation.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "date",
            F.col("n_nationkey").cast("double").alias("latitude"),
            F.col("n_regionkey").cast("double").alias("longitude"),
            "temperature_2m_max",
            "temperature_2m_min",
        )

    def item(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("item_code"),
            F.col("p_name").alias("item_name"),
            F.col("p_type").alias("item_group"),
        )

    def item_price(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_name").alias("item_name"),
            F.col("p_retailprice").alias("price_list_rate"),
            F.lit("PKR").alias("currency"),
        )

    # --- sales ----------------------------------------------------------------------------

    def invoice_items(self) -> DataFrame:
        """Order lines as point-of-sale lines; the supplier is the selling warehouse."""
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("l_shipdate").alias("creation"),
                F.col("p_type").alias("item_group"),
                F.col("p_name").alias("item_name"),
                F.col("s_name").alias("warehouse"),
                F.col("l_quantity").alias("qty"),
            )
        )

    def sales_lines(self) -> DataFrame:
        """Sales not yet summed per day: enough for sums, ranges and distinct names.

        The branch lookup is done here as two steps, supplier to nation key to name, on
        tables whose size Spark knows; the joined map would look too big to broadcast.
        """
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.to_date("l_shipdate").alias("date"),
                F.coalesce(F.lower("n_name"), F.col("s_name")).alias("branch"),
                F.col("p_type").alias("item_group"),
                F.col("p_name").alias("item_name"),
                F.col("l_quantity").alias("qty_sold"),
            )
        )

    def invoiced_lines(self) -> DataFrame:
        """Order lines that the stock ledger calls invoices."""
        return self.table("lineitem").filter(F.col("l_returnflag") == "N")

    def sold_branches(self, lines: DataFrame | None = None) -> DataFrame:
        """Quantity per warehouse under its branch's name: enough for totals by branch.

        Lines are summed per warehouse key first, so the joins see a row per warehouse.
        """
        lines = self.table("lineitem") if lines is None else lines
        sums = lines.groupBy("l_suppkey").agg(
            F.sum("l_quantity").alias("qty_sold")
        )
        return (
            sums.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(F.coalesce(F.lower("n_name"), F.col("s_name")).alias("branch"), "qty_sold")
        )

    def sold_items(self, lines: DataFrame | None = None) -> DataFrame:
        """Item and group of every item key with a line.

        Items are looked up in the distinct keys, not the other way round: a file of names that recur is
        far smaller than the rows that Spark would broadcast for its size."""
        lines = self.table("lineitem") if lines is None else lines
        keys = lines.select(F.col("l_partkey").alias("item_code")).distinct()
        return self.item().join(keys, "item_code", "left_semi").select("item_group", "item_name")

    def sold_days(self) -> DataFrame:
        return self.table("lineitem").select(F.to_date("l_shipdate").alias("date"))

    def store(self) -> EnrichedStore:
        """The store of enriched sales that ingest keeps for these tables: loaded when it is first
        asked for in a session, and read by all later queries."""
        key = (self.spark.sparkContext.applicationId, self.root)
        if key not in _STORES:
            store = EnrichedStore(self.spark, run_dir(self.spark, "store"))
            refresh_enriched(
                self.invoice_items(), self.stored_branch_map(), self.branch_dim(),
                self.stored_weather(), store,
            )
            _STORES[key] = store.path
        return EnrichedStore(self.spark, _STORES[key])

    def sales(self) -> DataFrame:
        return self.store().read().select(*SALES_KEY, "qty_sold")

    def stored_weather(self) -> DataFrame:
        """Weather as the table it is in the field: one row per place and day."""
        return self._once("weather", self.weather)

    def branch_weather(self) -> DataFrame:
        return enrich.weather_by_branch(self.stored_weather(), self.branch_dim())

    def fact(self) -> DataFrame:
        """The stored enriched sales."""
        return self.store().read()

    def means(self) -> Column:
        """Mean temperatures of the stored sales."""
        return self.store().means()

    def last_day(self) -> str:
        """The same day as text, for what reads the months around it only."""
        return str(self.table("lineitem").agg(F.max("l_shipdate").cast("date")).first()[0])

    def as_of(self) -> Column:
        """The last day with a line, used wherever the reports say today."""
        return self.table("lineitem").select(F.max("l_shipdate").cast("date")).scalar()

    # --- stock ----------------------------------------------------------------------------

    def month_moves(self) -> DataFrame:
        """Stored sums of what left a warehouse per item and month; loaded once in a session."""
        key = (self.spark.sparkContext.applicationId, f"{self.root}#moves")
        if key not in _STORES:
            path = run_dir(self.spark, "moves")
            moves = self.table("lineitem").select(
                F.to_date("l_shipdate").alias("date"),
                F.col("l_suppkey").alias("warehouse_key"),
                F.col("l_partkey").alias("item_code"),
                F.col("l_quantity").alias("moved"),
            )
            FactStore(self.spark, path, MOVES).create(stock.month_moves(moves), by_month=True)
            _STORES[key] = path
        return FactStore(self.spark, _STORES[key], MOVES).read()

    def stock_ledger(
        self,
        branches: Sequence[str] | None = None,
        names: Selection = None,
        until: str | None = None,
        since: str | None = None,
    ) -> DataFrame:
        """One entry per warehouse, item, day, status and voucher, with the running balance.

        Lines are summed per entry before the running sum, so its windows grow with the
        calendar and not with the number of lines. A choice of branches and items, the keys of
        the running sum, and the last day asked for leave out lines before it. With ``since``, only
        lines from the start of that day's month on are read, and entries before the day left out:
        what moved in earlier months comes from stored sums. These entries are written, so that their
        size is known where the sums are looked up by their keys.
        """
        keys = ["warehouse", "item_code", "posting_date", "docstatus", "voucher_type"]
        lines, suppliers = self.table("lineitem"), self.table("supplier")
        first = None if since is None else date.fromisoformat(since)
        if first is not None:
            month = F.lit(first.replace(day=1)).cast("timestamp_ntz")
            lines = lines.filter(F.col("l_shipdate") >= month)
        if until is not None:
            after = F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz")
            lines = lines.filter(F.col("l_shipdate") < after)
        if names is not None:
            chosen = choose(self.item(), "item_name", names)
            wanted = chosen.select(F.col("item_code").alias("l_partkey"))
            lines = lines.join(wanted, "l_partkey", "left_semi")
        if branches is not None:
            codes = lookup.codes_of_branches(self.stored_branch_map(), branches)
            wanted = codes.select(F.col("code").alias("s_name"))
            suppliers = suppliers.join(wanted, "s_name", "left_semi")
        entries = (
            lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(
                F.col("s_name").alias("warehouse"),
                F.col("l_suppkey").alias("warehouse_key"),
                F.col("l_partkey").alias("item_code"),
                F.to_date("l_shipdate").alias("posting_date"),
                F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("docstatus"),
                F.when(F.col("l_returnflag") == "N", VOUCHER)
                .when(F.col("l_returnflag") == "A", "Stock Entry")
                .otherwise("Stock Reconciliation")
                .alias("voucher_type"),
            )
            .agg(F.sum("l_quantity").alias("moved"))
        )
        so_far = (
            Window.partitionBy("warehouse_key", "item_code")
            .orderBy("posting_date", "docstatus", "voucher_type")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        found = entries.withColumn("moved", F.sum("moved").over(so_far))
        left = OPENING_STOCK - F.col("moved")
        if first is not None:
            found = materialize(found.filter(F.col("posting_date") >= F.lit(first)), "entries")
            before = stock.moved_before(self.month_moves(), first, found)
            found = found.join(before, ["warehouse_key", "item_code"], "left")
            left = left - F.coalesce("moved_before", F.lit(0.0))
        return found.select(*keys, left.alias("qty_after_transaction"))

    def balance(self, day: str | None = None) -> DataFrame:
        """Lowest balance per branch, item, day and voucher, as the chat's balance file; of one
        day, if that is all that is asked for."""
        named = self.stock_ledger(until=day, since=day).join(self.item(), "item_code")
        return (
            lookup.map_branches_counted(named, self.stored_branch_map())
            .groupBy("item_name", "branch", "item_group", "posting_date", "voucher_type")
            .agg(F.min("qty_after_transaction").cast("int").alias("balance"))
            .withColumnRenamed("posting_date", "date")
        )

    # --- texts ----------------------------------------------------------------------------

    def questions(self) -> DataFrame:
        """Conversation turns with a question added.

        User turns ask for the item and the branch that share the conversation's number,
        assistant turns misspell the item by leaving out its last letter. Only items with such a number
        are kept for the join, as it may broadcast them.
        """
        said = self.table("conversations")
        numbers = said.select(F.col("conv_id").alias("p_partkey")).distinct()
        item = (
            self.table("part")
            .select("p_partkey", F.col("p_name").alias("_item"))
            .join(numbers, "p_partkey", "left_semi")
        )
        branch = self.branch_map_by_number()
        turns = (
            said.join(item, F.col("conv_id") == F.col("p_partkey"), "left")
            .join(branch, F.col("conv_id") == F.col("_number"), "left")
        )
        misspelt = F.expr("left(_item, length(_item) - 1)")
        question = (
            F.when(
                F.col("role") == "user",
                F.concat_ws(" ", F.lit("how many"), "_item", F.lit("were sold at"), "_branch"),
            )
            .when(F.col("role") == "assistant", F.concat_ws(" ", F.lit("stock of"), misspelt))
            .otherwise("")
        )
        return turns.select(
            F.concat_ws("-", "conv_id", "turn").alias("text_id"),
            "conv_id",
            F.concat_ws(" ", "text", question).alias("text"),
        )

    def branch_map_by_number(self) -> DataFrame:
        nation = self.table("nation")
        return (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("_number"), F.lower("n_name").alias("_branch"))
        )

    def question_scores(self) -> DataFrame:
        """Labels of the document with the conversation's number, as attribute scores."""
        scores = F.create_map(
            F.lit("TOXICITY"), F.col("toxic") * F.lit(0.9),
            F.lit("INSULT"), (1 - F.col("quality")) * F.lit(0.5),
        )
        return (
            self.questions()
            .join(self.table("labels"), F.col("conv_id") == F.col("doc_id"))
            .select("text_id", scores.alias("scores"))
        )

    def event_stream(self) -> DataFrame:
        return (
            self.spark.readStream.schema(TABLES["events"])
            .option("pathGlobFilter", "events.parquet")
            .parquet(self.root)
        )
