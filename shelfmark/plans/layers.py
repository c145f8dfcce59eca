"""Staging and intermediate layers: pure functions from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dates import DateWindow, cut
from ..operators.grain import dedup_by_grain

LINE_GRAIN = ["order_id", "line_no"]
LINE_ORDER = ["line_amount", "quantity", "unit_price", "sku"]


def stage_stores(raw: DataFrame) -> DataFrame:
    return raw.select("store_id", "store_code", "city", "store_format", "opened_on")


def stage_orders(raw: DataFrame) -> DataFrame:
    return raw.select("order_id", "store_id", "order_ts", "order_date", "channel", "status", "customer_id", (F.col("status") == "cancelled").alias("is_cancelled"), (F.col("channel") == "offline").alias("is_offline"))


def stage_order_items(raw: DataFrame) -> DataFrame:
    """One row a line. order_date follows from order_id; it is in the key so that a date filter reaches the scan."""
    return dedup_by_grain(raw, ["order_date", *LINE_GRAIN], LINE_ORDER)


def stage_returns(raw: DataFrame) -> DataFrame:
    return raw.select("return_id", "order_id", "order_date", "line_no", "returned_date", F.datediff("returned_date", "order_date").alias("delay_days"), "quantity", "returned_amount")


def stage_cancellations(raw: DataFrame) -> DataFrame:
    return raw.select("cancellation_id", "order_id", "order_date", "cancelled_date", F.datediff("cancelled_date", "order_date").alias("delay_days"), "reason")


def stage_traffic(raw: DataFrame) -> DataFrame:
    return raw.select("store_id", "traffic_date", "visitors")


def order_lines(items: DataFrame, orders: DataFrame, window: DateWindow | None = None) -> DataFrame:
    """Lines with their order's store, channel and state; a line without an order stays, with nulls.

    A line carries its order's date, so a window cuts both sides."""
    lines = cut(items, "order_date", window)
    heads = cut(orders, "order_date", window).select("order_id", "store_id", "channel", "is_cancelled", "is_offline")
    return lines.join(heads, "order_id", "left").select("order_id", "line_no", "order_date", "store_id", "channel", "is_cancelled", "is_offline", "sku", "quantity", "unit_price", "line_amount", "source_copies")


def returns_attributed(returns: DataFrame, orders: DataFrame) -> DataFrame:
    """Returns with their order's store; they belong to the day of purchase, and carry the day they came in."""
    heads = orders.select("order_id", "store_id", "is_cancelled")
    return returns.join(heads, "order_id", "left").select("return_id", "order_id", "line_no", "store_id", "is_cancelled", "order_date", "returned_date", "delay_days", "quantity", "returned_amount")
