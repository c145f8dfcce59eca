"""The raw layer seen in a TPC-H-like star schema (regions as stores) and in an event stream (users as stores)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grain import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("int").alias("store_id"), F.concat(F.lit("S"), F.col("r_regionkey")).alias("store_code"), F.col("r_name").alias("city"), F.lit("medium").alias("store_format"),
        F.date_add(F.lit("1995-01-01").cast("date"), (100 * F.col("r_regionkey")).cast("int")).alias("opened_on"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are few and customers' keys unique, so the two lookups broadcast when Spark finds them small."""
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    return _table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_id"), F.col("n_regionkey").cast("int").alias("store_id"), F.col("o_orderdate").alias("order_ts"), F.col("o_orderdate").cast("date").alias("order_date"),
        F.when(F.col("o_orderkey") % 3 == 0, "offline").when(F.col("o_orderkey") % 3 == 1, "web").otherwise("app").alias("channel"),
        F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("placed").alias("status"), F.col("o_custkey").alias("customer_id"),
    )


def n_lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the lines as exported, from the files' footers."""
    return _table(spark, sf_dir, "lineitem").count()


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and their orders are spread by the order, so what follows by order or line takes no other shuffle, in tasks that do not grow with the table."""
    dates = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    n = n_lines(spark, sf_dir)
    return spread(_table(spark, sf_dir, "lineitem"), n, "l_orderkey").join(spread(dates, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"), "order_date", F.col("l_linenumber").cast("int").alias("line_no"), F.concat(F.lit("P"), F.col("l_partkey")).alias("sku"),
        F.col("l_quantity").cast("int").alias("quantity"), (F.floor(cents / F.col("l_quantity").cast("int")) / 100).cast("decimal(10,2)").alias("unit_price"),
        (cents / 100).cast("decimal(12,2)").alias("line_amount"), F.col("l_returnflag").alias("return_flag"), F.col("l_shipdate").cast("date").alias("ship_date"),
    )


#: Days from purchase to return at most.
LONGEST_DELAY = 30


def returned_date() -> Column:
    """When a line comes back, if it does."""
    return F.date_add("order_date", ((F.col("order_id") * 7 + F.col("line_no")) % (LONGEST_DELAY + 1)).cast("int"))


def returns(lines: DataFrame) -> DataFrame:
    """Returns of deduplicated lines that carry the flag R, 0 to 30 days after purchase."""
    return lines.filter("return_flag = 'R'").select(
        (F.col("order_id") * 10 + F.col("line_no")).alias("return_id"), "order_id", "order_date", "line_no", returned_date().alias("returned_date"), "quantity", F.col("line_amount").alias("returned_amount")
    )


def cancellations(orders_: DataFrame) -> DataFrame:
    """One row for a cancelled order, but for every 41st, and one row too many for every 97th live one."""
    gone = F.col("status") == "cancelled"
    return orders_.filter((gone & (F.col("order_id") % 41 != 0)) | (~gone & (F.col("order_id") % 97 == 0))).select(
        F.col("order_id").alias("cancellation_id"), "order_id", "order_date", F.date_add("order_date", (F.col("order_id") % 3).cast("int")).alias("cancelled_date"), F.lit("changed mind").alias("reason")
    )


def shipment_traffic(items: DataFrame, orders_: DataFrame) -> DataFrame:
    """Counter readings for the regions: a store-day has one if any of its lines was shipped, and lines of more than 25 units count as visitors."""
    return items.join(orders_.select("order_id", "store_id"), "order_id").groupBy("store_id", F.col("ship_date").alias("traffic_date")).agg(F.count_if(F.col("quantity") > 25).cast("int").alias("visitors"))


def event_stores(events: DataFrame) -> DataFrame:
    first = events.agg(F.min(F.col("ts").cast("date")).alias("opened_on"))
    return events.select(F.col("user_id").cast("int").alias("store_id")).distinct().crossJoin(F.broadcast(first))  # one row


def event_traffic(events: DataFrame) -> DataFrame:
    """A store-day has a counter reading if anything was viewed or clicked; only views count as visitors."""
    seen = events.filter(F.col("event_type").isin("view", "click"))
    return seen.groupBy(F.col("user_id").cast("int").alias("store_id"), F.col("ts").cast("date").alias("traffic_date")).agg(F.count_if(F.col("event_type") == "view").cast("int").alias("visitors"))


def event_orders(events: DataFrame) -> DataFrame:
    rest = events.filter(~F.col("event_type").isin("view", "click"))
    return rest.select(F.col("event_id").alias("order_id"), F.col("user_id").cast("int").alias("store_id"), F.col("ts").alias("order_ts"), F.col("ts").cast("date").alias("order_date"), F.lit("offline").alias("channel"), F.when(F.col("event_type") == "purchase", "placed").otherwise("cancelled").alias("status"), F.lit(None).cast("long").alias("customer_id"))
